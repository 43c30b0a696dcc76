"""Document-intelligence and redaction analytics on Spark DataFrames."""
