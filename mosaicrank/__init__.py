"""A multi-vector search engine on Spark DataFrames."""
