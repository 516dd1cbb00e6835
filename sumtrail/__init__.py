"""Revenue analytics on Spark DataFrames."""
