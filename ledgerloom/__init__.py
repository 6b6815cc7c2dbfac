"""Document-to-register analytics on Spark."""
