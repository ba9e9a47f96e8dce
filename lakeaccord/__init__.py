"""Semantic-conflict analytics for lakehouse columns, on PySpark DataFrames."""
