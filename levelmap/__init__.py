"""Option-dealer price-level analytics on Spark DataFrames."""
