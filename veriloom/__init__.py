"""Spark-first engine for evidence retrieval, verification and rater statistics."""
