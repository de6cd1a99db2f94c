"""Vector search and data processing on Spark DataFrames."""
