"""Ground-motion analytics on Spark DataFrames."""
