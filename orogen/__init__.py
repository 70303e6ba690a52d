"""orogen: terrain analytics on Spark DataFrames."""
