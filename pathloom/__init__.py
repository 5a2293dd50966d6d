"""pathloom: graph, path and result analytics over Spark DataFrames."""
