"""Structured Streaming scorers."""
