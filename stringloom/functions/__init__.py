"""The predicates as SQL functions."""
