"""barstrata: point-in-time market-structure analytics as Spark DataFrame jobs."""
