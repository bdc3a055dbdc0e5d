"""Column functions: every one of them is built from Spark's own expressions."""
