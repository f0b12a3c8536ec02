"""Entity-observation analytics on Spark DataFrames."""
