"""leafwise: page-level document routing and judge evaluation on Spark DataFrames."""
