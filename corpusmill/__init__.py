"""Corpus building and batch retrieval on Spark DataFrames."""
