"""News topics and trends as Spark DataFrames."""
