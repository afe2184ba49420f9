"""Keyed relational analytics on PySpark: plans as data, compiled to DataFrames."""
