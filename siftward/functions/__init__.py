"""Column expressions: one row in, one value out, all built-in functions."""
