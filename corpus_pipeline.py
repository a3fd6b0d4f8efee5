"""The corpus pipeline: five stages, each on all that the one before kept.

Rules drop documents, two stages of deduplication leave one document of each
group, secrets are masked in the texts that stay, and these are packed into
training sequences.  All stages but the last return the columns of documents.

A row is named by its id and a 128-bit hash of its text, so rows that repeat an id
with another text are judged apart.

Defined results of all stages: an empty table gives no rows.  A null or empty text
has no words, so the rules drop it; in the other stages null and empty are one
text.  Long texts are read whole.  Of rows repeated with id and text one stays
after the second stage.  Of equal texts the row with the most code points stays,
then the smallest id; of near copies the one with the smallest id, null ids last.
Columns of any other name pass through all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm.common import checkpoint, maybe_broadcast, remove, shared_dir, table
from stringloom.llm.exact_dedup import exact_dedup
from stringloom.llm.packing import best_fit
from stringloom.llm.quality_rules import quality_rules as rules
from stringloom.llm.secret_scan import redact
from stringloom.llm.simhash import similar_texts

#: SQL can express neither the certified cutoffs nor the packing.
ORACLE_SQL = None


def _key(docs: DataFrame) -> Column:
    body = F.coalesce(docs["text"], F.lit("")).cast("binary")
    # The flag comes first, so that null ids are last.
    return F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("doc_id"), F.xxhash64(body).alias("sig"), F.xxhash64(F.md5(body)).alias("sig2"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The keys and texts of ``docs``; whatever else these hold cannot clash."""
    return docs.select(_key(docs).alias("key"), docs["text"])


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose key (id, 128 bits of text hash) is in ``keys.key``, or is not."""
    keys = checkpoint(keys.select("key.*").distinct())
    keys = maybe_broadcast(keys, keys.count(), 32)
    key = _key(docs)
    return docs.join(keys, key["doc_id"].eqNullSafe(keys["doc_id"]) & (key["sig"] == keys["sig"]) & (key["sig2"] == keys["sig2"]), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = rules(_keyed(docs).select("key.doc_id", "key", "text"), table(spark, sf_dir, "labels"), carry=("key",))
    return _joined(docs, judged.filter(~F.col("kept")), "left_anti")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    judged = checkpoint(exact_dedup(_keyed(docs), "key").select(F.col("doc_id").alias("key"), F.col("keep_id"), "kept"))
    kept = _joined(docs, judged.filter(~F.col("kept") & ~F.col("key").eqNullSafe(F.col("keep_id"))), "left_anti")
    again = checkpoint(judged.filter(~F.col("kept") & F.col("key").eqNullSafe(F.col("keep_id"))).select("key").distinct())
    if again.isEmpty():
        return kept
    # Rows repeated with id and text: one of each comes back.
    once = _joined(kept, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return _joined(kept, again, "left_anti").unionByName(once)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of five-word Jaccard similarity 0.8."""
    judged = similar_texts(_keyed(docs), "key").withColumnRenamed("doc_id", "key")
    return _joined(docs, judged.filter(~F.col("key").eqNullSafe(F.col("component_id"))), "left_anti")


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and their lengths brought up to date."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return best_fit(docs, ranks=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicate_groups),
    ("secret scans", secret_masks),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result is written to the shared folder and read again, and goes once the next is written."""
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
