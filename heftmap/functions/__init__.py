"""Column expressions: every function takes and returns Spark Columns and stays in the JVM."""
