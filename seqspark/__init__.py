"""Batch analytics for large tables of DNA sequences, as Spark DataFrame jobs."""
