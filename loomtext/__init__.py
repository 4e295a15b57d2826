"""Spark-first document ingestion and text analytics."""
