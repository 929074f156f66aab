"""Cohort analytics on Spark DataFrames."""
