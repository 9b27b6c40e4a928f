"""Weftline: catalogue resolution, evaluation analytics and corpus operators on PySpark."""
