"""Retrieval, knowledge-store and task analytics as Spark DataFrame functions."""
