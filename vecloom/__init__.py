"""Compressed-vector retrieval analytics on PySpark."""
