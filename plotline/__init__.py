"""plotline: address matching and address quality on Spark DataFrames."""
