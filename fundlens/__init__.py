"""Research-funding analytics as Spark DataFrame jobs."""
