"""Lodestone: retrieval analytics over long documents, on Spark DataFrames."""
