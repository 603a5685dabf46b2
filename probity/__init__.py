"""Research-integrity screening and corpus preparation on Spark DataFrames."""
