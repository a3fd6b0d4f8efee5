"""Predicates and codec on Structured Streaming DataFrames."""
