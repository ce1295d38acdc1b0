"""Structure analytics on Spark DataFrames."""
