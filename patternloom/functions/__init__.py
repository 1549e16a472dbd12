"""Column expressions: set-valued equality, annotation, dual-typed scalars, hashes, question fields."""
