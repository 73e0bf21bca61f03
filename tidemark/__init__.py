"""Time-series feature, join, evaluation and text operators on Spark DataFrames."""
