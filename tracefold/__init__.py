"""Session-log, recall and memory-ledger analytics on Spark DataFrames."""
