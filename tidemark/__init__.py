"""Tidemark: labelled-transaction analytics as Spark DataFrame jobs."""
