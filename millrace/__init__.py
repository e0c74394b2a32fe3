"""Named analytics operators and queries for Spark, on DataFrames, SQL and Structured Streaming."""
