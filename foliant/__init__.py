"""Foliant: document analytics on PySpark, declared with DataFrames and SQL expressions."""
