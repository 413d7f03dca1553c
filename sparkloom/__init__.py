"""sparkloom: code-and-schema graphs, hybrid retrieval and training-data preparation on Spark DataFrames."""
