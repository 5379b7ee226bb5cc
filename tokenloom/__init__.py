"""Token-cost analytics and training-data preparation on Spark DataFrames."""
