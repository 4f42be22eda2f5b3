"""Construction analytics on Spark: operators are functions from DataFrames to DataFrames."""
