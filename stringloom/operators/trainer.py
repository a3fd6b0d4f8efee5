"""Dictionary training: a bounded, hash-ordered sample goes through one merge loop.

Merges depend on all merges before them, so one dictionary is one loop; what is
distributed is the choice of the sample.  It is the rows with the smallest hash
of (seed, key), whatever the partitioning, so equal inputs train equal
dictionaries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.operators.config import MAX_TOKEN, DynamicThreshold, TrainingConfig, max_dict_size, merge_count
from stringloom.operators.dictionary import Dictionary, Matcher


def train(rows: Iterable[bytes], config: TrainingConfig, total: int | None = None) -> Dictionary:
    """Merge adjacent tokens of ``rows``, read in order; ``total`` bytes set the budget (all of the rows by default)."""
    rows = [r for r in rows if r]
    room = max_dict_size(config.bits) - 256
    if isinstance(config.threshold, DynamicThreshold):
        left = int((sum(map(len, rows)) if total is None else total) * config.threshold.sample_fraction)
        wanted = merge_count(b"".join(rows)[:left], room)
    else:
        left, wanted = sum(map(len, rows)), config.threshold.value
    vocab = [bytes([b]) for b in range(256)]
    match = Matcher({b: i for i, b in enumerate(vocab)})
    seen: Counter[tuple[int, int]] = Counter()
    for row in rows:
        if left <= 0 or len(vocab) == 256 + room:
            break
        row = row[:left]
        left -= len(row)
        at, last = 0, None
        while at < len(row) and len(vocab) < 256 + room:
            token, n = match.longest(row, at)
            at += n
            if last is not None and len(vocab[last]) + n <= MAX_TOKEN:
                seen[last, token] += 1
                if seen[last, token] >= wanted:
                    del seen[last, token]
                    grown = vocab[last] + vocab[token]
                    token = match.ids.get(grown)
                    if token is None:  # else it was made before, from other parts
                        token = len(vocab)
                        vocab.append(grown)
                        match.add(grown, token)
            last = token
    return Dictionary(sorted(vocab))


def value_bytes(df: DataFrame, col: str) -> Column:
    """A STRING or BINARY column as bytes."""
    return F.col(col).cast("binary") if df.schema[col].dataType.typeName() != "binary" else F.col(col)


def sample_rows(df: DataFrame, key: str, col: str, config: TrainingConfig) -> tuple[list[bytes], int]:
    """Rows to train on, in hash order, and the byte total that sets the budget."""
    size = F.octet_length(F.col(col))
    rows = df.filter(size > 0).select(F.xxhash64(F.lit(config.seed), F.col(key)).alias("h"), value_bytes(df, col).alias("b"))
    total = rows.agg(F.sum(F.octet_length("b"))).first()[0] or 0
    share = config.threshold.sample_fraction if isinstance(config.threshold, DynamicThreshold) else 1.0
    need = min(config.sample_bytes, int(total * share))
    if not need:
        return [], 0
    # A little more than needed lies below the cut; rows longer than the whole sample are of no use here.
    cut = min(1.0, 1.25 * need / total + 0.001)
    low = rows.filter((F.col("h") <= min(2**63 - 1, int((2 * cut - 1) * 2**63))) & (F.octet_length("b") <= config.sample_bytes))
    out, have = [], 0
    for r in low.orderBy("h", "b").toLocalIterator():
        out.append(bytes(r["b"]))
        have += len(out[-1])
        if have > need:
            break
    return out, int(min(total, config.sample_bytes / share))


def train_dictionary(df: DataFrame, key: str, col: str, config: TrainingConfig | None = None) -> Dictionary:
    """A dictionary for ``df[col]``; nulls and empty values are skipped."""
    config = config or TrainingConfig()
    rows, total = sample_rows(df, key, col, config)
    return train(rows, config, total)
