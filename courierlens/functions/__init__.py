"""Column expressions: clock arithmetic, business rules, measures."""
