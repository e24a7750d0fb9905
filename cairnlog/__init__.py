"""Versioned key-value log analytics on Spark DataFrames."""
