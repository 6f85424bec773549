"""Catalog, document and corpus operators on Spark DataFrames."""
