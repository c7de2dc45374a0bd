"""Column-expression builders and numeric worker routines."""
