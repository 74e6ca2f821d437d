"""Point-in-time analytics for two-party events, on Spark DataFrames."""
