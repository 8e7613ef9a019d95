"""Code intelligence and context retrieval on Spark."""
