"""Dynamic connectivity analytics on Spark DataFrames."""
