"""annolens: annotation-evaluation analytics on Spark DataFrames."""
