"""Spark-first document text analytics."""
