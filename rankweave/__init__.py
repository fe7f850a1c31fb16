"""Contest ratings and analytics as Spark jobs."""
