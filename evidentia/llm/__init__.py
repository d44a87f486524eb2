"""Operators of a training-data pipeline over a table of documents.

Every operator takes and returns DataFrames; nothing else in the library imports this subpackage.
"""
