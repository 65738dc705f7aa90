"""Document-finance analytics as PySpark jobs."""
