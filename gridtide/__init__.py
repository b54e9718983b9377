"""gridtide: hourly panel analytics on Spark DataFrames."""
