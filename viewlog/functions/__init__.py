"""Column expressions: text layouts, scalars and repeatable random draws."""
