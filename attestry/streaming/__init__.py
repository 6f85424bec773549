"""Streaming on DataFrames."""
