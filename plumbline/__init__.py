"""Plumbline: evaluation analytics and training-data operators as Spark DataFrame plans."""

__version__ = "0.2.0"
