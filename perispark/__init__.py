"""Attack-surface analytics on Spark DataFrames."""
