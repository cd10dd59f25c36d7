"""Path algebra and corpus processing on Spark DataFrames."""
