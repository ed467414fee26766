"""Spark-first analytics over controlled vocabularies held as a table of statements."""

__version__ = "0.1.0"
