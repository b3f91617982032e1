"""Event-time record processing on Spark DataFrames."""
