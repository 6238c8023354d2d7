"""Document analytics on Spark: documents as tables of blocks, queried with DataFrames."""
