"""Route analytics on Spark DataFrames."""
