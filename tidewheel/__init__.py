"""Candidate retrieval, ranking and corpus analytics as PySpark DataFrame jobs."""
