"""flowlens: estate-wide analytics over exported dataflow templates, on Spark DataFrames."""
