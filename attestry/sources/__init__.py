"""Sources on DataFrames."""
