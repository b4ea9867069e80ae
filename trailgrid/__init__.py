"""Search and maintenance of very large collections of file paths on Spark."""
