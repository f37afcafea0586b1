"""Event and interval analytics on Spark DataFrames."""
