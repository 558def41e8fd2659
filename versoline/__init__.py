"""versoline: text-and-timeline analytics as PySpark DataFrame jobs."""
