"""millrace: process-trace analytics on Spark DataFrames."""
