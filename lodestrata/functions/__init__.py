"""Scalar functions as Column expressions, and byte transforms for Python workers."""
