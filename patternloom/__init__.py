"""Pattern joins and corpus operators on Spark DataFrames."""
