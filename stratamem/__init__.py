"""Graph-memory analytics on Spark: retrieval, graph, provenance and data-pipeline operators."""
