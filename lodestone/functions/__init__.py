"""Column functions: identity, text, time, arrays."""
