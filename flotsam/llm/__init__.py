"""Training-data operators on Spark DataFrames; nothing outside this folder imports them."""
