"""Labelled-table classification analytics on Spark DataFrames."""
