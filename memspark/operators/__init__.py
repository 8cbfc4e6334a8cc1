"""Operators over document-memory DataFrames."""
