"""Audience analytics operators for Spark DataFrames."""
