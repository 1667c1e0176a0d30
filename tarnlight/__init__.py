"""Knowledge retrieval and memory analytics as functions over Spark DataFrames."""
