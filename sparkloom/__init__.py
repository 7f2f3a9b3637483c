"""Code intelligence on Spark: scans, chunking, property graph, search and impact, as DataFrame operations."""
