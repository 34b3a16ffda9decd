"""Evidence-first analytics over a software supply-chain graph, on Spark DataFrames."""
