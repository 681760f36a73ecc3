"""Decision-log analytics on Spark DataFrames."""
