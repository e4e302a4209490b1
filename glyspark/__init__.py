"""Continuous glucose monitoring analytics on Spark DataFrames."""
