"""Spatial-evidence analytics on PySpark DataFrames."""
