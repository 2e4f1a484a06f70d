"""Operators of a training-data pipeline over a table of documents.

Each operator takes DataFrames and column names and returns a DataFrame. Only
the named columns are read, so other columns may have any name.
"""
