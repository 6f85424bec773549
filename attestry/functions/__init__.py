"""Functions on DataFrames."""
