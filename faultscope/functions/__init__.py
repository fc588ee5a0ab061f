"""Column expressions: every function here returns a Spark ``Column``."""
