"""Source-code and document analytics on Spark DataFrames."""
