"""assaykit: text pools, model answers and their evaluation as Spark DataFrames."""
