"""Column expressions: vectors, scalars and predicates."""
