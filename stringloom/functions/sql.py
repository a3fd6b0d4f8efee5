"""Temporary SQL functions for the literal predicates; Catalyst inlines their bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "text_contains": ("s STRING, p STRING", "contains(s, p)"),
    "text_starts_with": ("s STRING, p STRING", "startswith(s, p)"),
    "text_equals": ("s STRING, p STRING", "s = p"),
    "text_contains_any": ("s STRING, ps ARRAY<STRING>", "CASE WHEN s IS NOT NULL THEN exists(ps, p -> contains(s, p)) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, (args, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS BOOLEAN RETURN {body}")
    return list(FUNCTIONS)
