"""Document-memory and retrieval analytics on Spark DataFrames."""
