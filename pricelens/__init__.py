"""pricelens: second-hand market intelligence as PySpark DataFrame transforms and streaming jobs."""
