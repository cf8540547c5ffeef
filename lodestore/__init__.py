"""Content-addressed dataset engine on Spark DataFrames."""
