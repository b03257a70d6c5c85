"""Event, point-process and signal encoding models on Spark DataFrames."""
