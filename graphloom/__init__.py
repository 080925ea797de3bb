"""Graph shapes and queries on Spark DataFrames."""
