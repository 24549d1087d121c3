"""guardlake: content safety, policy, audit and training-data operators on Spark DataFrames."""
