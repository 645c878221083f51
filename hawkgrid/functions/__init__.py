"""Column expressions and ordered-scan helpers."""
