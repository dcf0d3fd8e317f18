"""Analytics operators for large catalogues of annotated records, on Spark DataFrames."""
