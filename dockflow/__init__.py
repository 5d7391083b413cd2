"""Station activity analytics as Spark DataFrame jobs."""
