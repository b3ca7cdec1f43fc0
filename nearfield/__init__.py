"""Near-duplicate matching and decision analytics on Spark DataFrames."""
