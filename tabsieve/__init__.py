"""Table profiling, cleaning and association on Spark DataFrames."""
