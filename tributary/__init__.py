"""Record linkage and data processing on Spark DataFrames."""
