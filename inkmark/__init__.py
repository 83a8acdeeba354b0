"""Document authenticity analytics on Spark."""
