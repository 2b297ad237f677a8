"""Structure-dataset analytics on Spark: plain functions from DataFrames to DataFrames."""
