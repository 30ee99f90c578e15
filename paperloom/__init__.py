"""Document-item analytics on Spark."""
