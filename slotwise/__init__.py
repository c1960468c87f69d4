"""Associative-retrieval analytics on PySpark."""
