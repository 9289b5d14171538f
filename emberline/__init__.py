"""Environmental early-warning analytics as Spark DataFrame jobs."""
