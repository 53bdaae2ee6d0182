"""News and price-bar analytics on Spark DataFrames."""
