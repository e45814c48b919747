"""corvane: retrieval-oriented document analytics on Spark DataFrames."""
