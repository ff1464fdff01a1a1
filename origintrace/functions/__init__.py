"""Column expressions: column in, column out, no jobs."""
