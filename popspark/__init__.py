"""Population genetics on Spark DataFrames."""
