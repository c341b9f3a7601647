"""factorloom: factor mining and formula analytics on Spark DataFrames."""
