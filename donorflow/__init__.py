"""Longitudinal, per-subject event analytics on Spark DataFrames."""
