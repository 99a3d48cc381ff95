"""Document-to-bill-of-materials analytics on Spark DataFrames."""
