"""Hybrid document retrieval and training-data preparation on Spark DataFrames."""
