"""Millrace: corpus analytics on PySpark DataFrames."""
