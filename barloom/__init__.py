"""barloom: bar-series analytics on Spark DataFrames."""
