"""Predicates as immutable trees, with a raw and an encoded back end."""
