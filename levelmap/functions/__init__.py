"""Column expressions: one per rule, free of any DataFrame."""
