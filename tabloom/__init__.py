"""Tabular profiling, feature preparation and model evaluation on Spark DataFrames."""
