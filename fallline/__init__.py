"""fallline: mountain-activity analytics on Spark DataFrames."""
