"""Column expressions and small per-batch numeric helpers."""
