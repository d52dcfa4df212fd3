"""Operators over cell-time DataFrames."""
