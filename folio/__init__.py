"""Document analytics on Spark: DataFrame-in, DataFrame-out operators over documents, pages and their text."""
