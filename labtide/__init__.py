"""Lab-result drift analytics as Spark DataFrame jobs."""
