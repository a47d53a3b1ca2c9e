"""Operators for training-data pipelines over text tables.

Every operator is a function from DataFrames to a DataFrame.  Nothing outside
this subpackage imports it.
"""
