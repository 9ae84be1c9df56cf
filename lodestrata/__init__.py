"""Lodestrata: analytics over content-addressed snapshot stores, on PySpark."""

__version__ = "0.1.0"
