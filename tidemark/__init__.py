"""tidemark: multi-resolution time-series storage and querying on Spark DataFrames."""
