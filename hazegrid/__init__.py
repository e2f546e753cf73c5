"""Air-quality analytics on Spark DataFrames."""
