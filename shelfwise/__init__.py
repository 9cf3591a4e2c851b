"""Catalogue price intelligence on Spark: operators from DataFrames to DataFrames."""
