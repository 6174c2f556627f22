"""Retrieval-corpus building, batch search and evaluation as Spark jobs."""
