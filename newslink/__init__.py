"""News-event and article-revision analytics on Spark DataFrames."""
