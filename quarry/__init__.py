"""Quarry: source-code audit analytics on Spark DataFrames."""
