"""Top-k inner-product search over feature vectors, as Spark jobs."""
