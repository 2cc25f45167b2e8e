"""Health-data analytics on Spark."""
