"""Session analytics and training-data operators as plain Spark DataFrame jobs."""
