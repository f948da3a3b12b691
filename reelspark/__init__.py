"""Clip-annotation analytics as PySpark DataFrame plans."""
