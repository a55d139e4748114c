"""URL threat analytics on PySpark: features, list matching, sketches, redirect graphs, scoring, ranking."""

__version__ = "0.1.0"
