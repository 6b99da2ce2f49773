"""Column expressions and fixed metadata."""
