"""Spark-first feature/label relationship profiler and data-processing operators."""

__version__ = "0.1.0"
