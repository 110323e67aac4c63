"""Training-data operators: deduplication, archives, encoding, scoring and scans as Spark jobs."""
