"""Retrieval and corpus analytics written for Spark DataFrames."""
