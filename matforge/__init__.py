"""Material-catalog harmonisation on Spark DataFrames."""
