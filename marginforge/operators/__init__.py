"""Relational and training operators on DataFrames."""
