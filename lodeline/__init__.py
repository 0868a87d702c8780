"""lodeline: evidence mining over text, code and event corpora, as Spark DataFrames."""
