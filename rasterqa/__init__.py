"""Print-artwork quality and production-event analytics on Spark DataFrames."""
