"""Media-timeline and event analytics on Spark DataFrames."""
