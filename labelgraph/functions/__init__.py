"""Column expressions: text rules, parsing and geometry as ordered data."""
