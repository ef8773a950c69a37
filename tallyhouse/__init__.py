"""tallyhouse: business analytics operators on Spark DataFrames."""
