"""A data-governance engine on Spark: plain functions from DataFrames to DataFrames."""
