"""Column functions: each takes columns and returns a column, so Catalyst sees through it."""
