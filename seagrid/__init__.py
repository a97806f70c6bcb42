"""Gridded and ensemble marine-forecast analytics on Spark DataFrames."""
