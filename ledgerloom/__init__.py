"""Event-log coordination analytics on Spark DataFrames."""
