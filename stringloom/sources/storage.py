"""Encoded columns as a folder of Parquet: rows, dictionary and a version."""

from __future__ import annotations

from pyspark.sql import SparkSession

from stringloom.operators.column import EncodedColumn
from stringloom.operators.dictionary import Dictionary

VERSION = 1


def save(column: EncodedColumn, path: str, mode: str = "errorifexists") -> None:
    spark = column.df.sparkSession
    column.df.write.mode(mode).parquet(f"{path}/rows")
    column.dictionary_frame().write.mode(mode).parquet(f"{path}/dictionary")
    meta = [(VERSION, column.key, column.bits, column.text)]
    spark.createDataFrame(meta, "version int, key string, bits int, text boolean").write.mode(mode).parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> EncodedColumn:
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or meta["version"] != VERSION:
        raise ValueError(f"{path}: unknown version {meta and meta['version']}")
    dictionary = Dictionary.from_frame(spark.read.parquet(f"{path}/dictionary"))
    return EncodedColumn(spark.read.parquet(f"{path}/rows"), dictionary, meta["key"], meta["bits"], meta["text"])
