"""Ontology-learning analytics on Spark: DataFrames in, DataFrames out."""
