"""A TCP service over the engine and a client for it."""
