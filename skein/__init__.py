"""Spark-first graph-retrieval analytics."""
