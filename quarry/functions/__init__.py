"""Column expressions and driver-side scalar functions."""
