"""Rule-against-form audit engine on Spark DataFrames."""
