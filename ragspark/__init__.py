"""Retrieval and knowledge-base analytics as ordinary PySpark DataFrame operators."""

__version__ = "0.1.0"
