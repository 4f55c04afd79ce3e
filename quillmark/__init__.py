"""quillmark: retrieval analytics on Spark DataFrames."""
