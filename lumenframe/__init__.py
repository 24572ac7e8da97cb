"""Image, signal and feature-vector analytics expressed on Spark DataFrames."""
