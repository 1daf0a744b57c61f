"""A pattern-action analytics engine on Spark DataFrames."""
