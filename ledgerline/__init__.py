"""Company financial-statement analytics as Spark DataFrame jobs."""
