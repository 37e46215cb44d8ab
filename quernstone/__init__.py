"""Schema-driven data migration and corpus preparation on Spark DataFrames."""
