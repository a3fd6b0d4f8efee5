"""Stateless stream operators: filter by a predicate, encode, or scan encoded rows.

Each row is judged alone, so the batch expressions run on streams unchanged; no
watermark or state is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.operators.column import TOKENS
from stringloom.operators.dictionary import Dictionary
from stringloom.operators.encode import tokens_of
from stringloom.operators.shared import bounded
from stringloom.operators.trainer import value_bytes
from stringloom.plans.predicate import Predicate


def filter_rows(df: DataFrame, col: str, predicate: Predicate) -> DataFrame:
    """Rows of a batch or stream whose raw column satisfies the predicate."""
    return df.filter(predicate.column(F.col(col), df.schema[col].dataType))


def encode_stream(df: DataFrame, col: str, dictionary: Dictionary) -> DataFrame:
    """The stream with ``tokens`` in place of ``col``, under a dictionary trained before."""
    return bounded(df).withColumn(TOKENS, tokens_of(value_bytes(df, col), dictionary)).drop(col)


def scan_encoded(df: DataFrame, predicate: Predicate, dictionary: Dictionary) -> DataFrame:
    """Encoded rows of a stream that satisfy the predicate."""
    return bounded(df).filter(predicate.tokens(F.col(TOKENS), dictionary))
