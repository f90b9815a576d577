"""Column functions whose semantics Spark has no single built-in for."""
