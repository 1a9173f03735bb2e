"""Recommender and two-task learning data work on Spark DataFrames."""
