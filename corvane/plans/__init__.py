"""From text to a bound logical plan: lexer, grammar, binder, explain."""
