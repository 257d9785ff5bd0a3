"""Signal and array analytics on Spark DataFrames."""
