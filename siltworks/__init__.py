"""Data-quality and layered analytics pipelines on Spark DataFrames."""
