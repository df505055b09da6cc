"""Sylvan: interpretable tree-ensemble analytics on Spark DataFrames."""
