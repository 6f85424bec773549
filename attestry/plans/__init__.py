"""Plans on DataFrames."""
