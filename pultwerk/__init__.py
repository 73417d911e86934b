"""School data work as Spark DataFrame and Structured Streaming jobs."""
