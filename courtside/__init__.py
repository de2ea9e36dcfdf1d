"""Set-at-a-time sports-marketplace analytics on Spark DataFrames."""
