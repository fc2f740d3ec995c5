"""Semantic catalog deduplication as Spark jobs."""
