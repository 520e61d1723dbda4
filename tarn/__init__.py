"""Tarn: retrieval, verification and versioning of code and text on Spark DataFrames."""
