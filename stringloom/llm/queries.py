"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringloom.llm.quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringloom.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringloom.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stringloom.llm.byte_bpe import encode_frame

    return encode_frame(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringloom.llm.secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringloom.llm.packing import best_fit

    return best_fit(table(spark, sf_dir, "documents"))  # by words; the pipeline's stage packs tokens


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringloom.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringloom.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringloom.llm.passages import near_passages

    return near_passages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_html_extract, op3_exact_dedup, op4_byte_bpe, op5_secret_scan, op6_simhash, op7_best_fit, op8_quality_rules, op9_language_id, op10_near_passages)}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS place FROM d)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY place) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       place = 1 AS kept, sha256(t) AS text_sha256
FROM k""",
}
