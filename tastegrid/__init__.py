"""Collaborative filtering and category profiling as batch Spark jobs."""

__version__ = "0.1.0"
