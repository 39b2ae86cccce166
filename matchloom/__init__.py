"""Analytics for matching two document corpora, on Spark DataFrames."""
