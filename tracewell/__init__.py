"""Learning-event analytics on Spark DataFrames."""
