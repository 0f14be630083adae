"""quantloom: cross-sectional panel research and corpus preparation on Spark DataFrames."""
