"""Files, generated data and the wire format."""
