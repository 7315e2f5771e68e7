"""Column functions: each takes columns and returns a column, all on the JVM side."""
