"""Spark-first kernel and linear support-vector analytics."""
