"""A key-value engine over a columnar lake, built on Spark DataFrames."""
