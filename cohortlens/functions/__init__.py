"""Column expressions and default parameter values."""
