"""graphloom: document-to-graph analytics on Spark DataFrames."""
