"""Pattern matching, graph analytics and data preparation on Spark DataFrames."""
