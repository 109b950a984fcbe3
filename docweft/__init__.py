"""Documentation-corpus analytics on Spark DataFrames."""
