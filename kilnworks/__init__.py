"""Manufacturing and quoting analytics as Spark DataFrame, SQL, ML and streaming jobs."""
