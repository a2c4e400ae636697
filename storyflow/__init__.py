"""News and document intelligence on Spark DataFrames and streams."""
