"""Object-graph analytics on Spark DataFrames."""
