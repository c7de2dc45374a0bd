"""Whole queries over the benchmark tables."""
