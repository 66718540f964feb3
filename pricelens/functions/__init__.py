"""Column expressions: every function returns a Column and stays JVM-side."""
