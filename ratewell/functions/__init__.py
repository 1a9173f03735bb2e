"""Column-level functions: text rules and evaluation formulas."""
