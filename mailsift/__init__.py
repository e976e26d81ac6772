"""Search and analytics over mail and document tables, as PySpark DataFrame jobs."""
