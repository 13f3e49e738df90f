"""Graph motif analytics expressed as Spark DataFrames."""
