"""Quality rules with risk-controlled thresholds.

Base counts of every text give the fixed rule ``base_failed`` and four ratios.
For each ratio and each length stratum a cutoff is chosen from a fixed ladder,
from lenient to strict, on the labelled good documents: a cutoff is certified
when the exact (Clopper-Pearson) upper bound of its false-rejection rate is at
most ``alpha`` divided by the number of ratios, and the ladder stops at the
first cutoff that is not.  Stopping there is a fixed-sequence test, so no
correction is owed for the steps of a ladder; the confidence ``delta`` is
divided (Bonferroni) over ratios and strata.  With probability 1 - delta, no
stratum then loses more than ``alpha`` of its good documents to the ratios.
Where labels are too few to certify a cutoff, the ratio rejects nothing.

Defined results: a null text counts as empty (no words, so ``base_failed``).
Labels of documents that are missing, null labels and repeated labels are
ignored beyond the first value; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import exp, lgamma, log, log1p

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import as_bytes, checkpoint, map_batches

SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Upper bounds in words of the length strata; the last has none.
STRATA = (150, 600)
#: Ratio -> cutoffs from lenient to strict; above the certified one a document goes.
LADDERS = {
    "symbol_ratio": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "dup_line_ratio": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_ratio": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "long_word_ratio": (40, 30, 24, 20, 17, 15, 13, 12, 11, 10),
}


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, total, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def counts_of(text: bytes) -> tuple[int, int, int, int, int, int]:
    """COUNTS and the number of lines with a word."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    solid = text.translate(None, SPACES)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines)


def base_stats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carry``, COUNTS, n_lines and base_failed for every row."""
    names = [*COUNTS, "n_lines"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(counts_of(x.as_py()) for x in batch.column("__text")), strict=True))
        return pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in ("doc_id", *carry)}, **{n: pa.array(v, pa.int64()) for n, v in zip(names, rows, strict=True)}})

    kept = [f"doc_id {df.schema[doc_id].dataType.simpleString()}", *(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry)]
    cols = df.select(F.col(doc_id).alias("doc_id"), *carry, as_bytes(text).alias("__text"))
    out = map_batches(cols, run, ", ".join([*kept, *(f"{n} long" for n in names)]))
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def ratios() -> dict[str, Column]:
    over = lambda a, b: F.coalesce(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(0.0))
    return {"symbol_ratio": over("n_symbols", "word_chars"), "dup_line_ratio": over("n_dup_lines", "n_lines"), "repeat_ratio": over("n_repeat_words", "n_words"), "long_word_ratio": over("word_chars", "n_words")}


def stratum() -> Column:
    return reduce(lambda c, k: c + (F.col("n_words") >= STRATA[k]).cast("int"), range(len(STRATA)), F.lit(0))


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a rate, ``k`` events seen in ``n``: P(X <= k) = delta there."""
    if n == 0 or k >= n:
        return 1.0
    parts = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in range(k + 1)]

    def log_cdf(p: float) -> float:
        terms = [c + i * log(p) + (n - i) * log1p(-p) for i, c in enumerate(parts)]
        top = max(terms)
        return top + log(sum(exp(t - top) for t in terms))

    low, high = max(k / n, 1e-15), 1 - 1e-15
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if log_cdf(mid) > log(delta) else (low, mid)
    return high


def certified(stats: DataFrame, good: DataFrame, *, alpha: float = 0.04, delta: float = 0.05) -> dict[tuple[int, str], float]:
    """(stratum, ratio) -> certified cutoff, from the stats of the good documents ``good.doc_id``.

    Every labelled document counts; only a few dozen counts reach the driver.
    """
    held = stats.filter("not base_failed").join(good.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("stratum", stratum())
    sums = [F.sum((c > cut).cast("long")).alias(f"{name}:{i}") for name, c in ratios().items() for i, cut in enumerate(LADDERS[name])]
    rows = {r["stratum"]: r for r in held.groupBy("stratum").agg(F.count("*").alias("n"), *sums).collect()}
    out, tests = {}, len(LADDERS) * (len(STRATA) + 1)
    for s, r in rows.items():
        for name, ladder in LADDERS.items():
            for i, cut in enumerate(ladder):
                n, k = r["n"], r[f"{name}:{i}"]
                if k > alpha / len(LADDERS) * n or binomial_upper(k, n, delta / tests) > alpha / len(LADDERS):
                    break
                out[s, name] = cut
    return out


def quality_rules(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", *, label_id: str = "doc_id", quality: str = "quality", alpha: float = 0.04, delta: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the columns ``carry``, COUNTS, base_failed, kept.

    ``kept`` is false for ``base_failed`` and for a ratio above its certified cutoff.
    """
    stats = checkpoint(base_stats(df, doc_id, text, carry=carry))
    good = labels.filter(F.col(quality) == 1).select(F.col(label_id).alias("doc_id"))
    cuts, by = certified(stats, good, alpha=alpha, delta=delta), ratios()
    bad = [(stratum() == s) & (by[name] > cut) for (s, name), cut in sorted(cuts.items())]
    verdict = ~F.col("base_failed") & ~reduce(lambda a, b: a | b, bad, F.lit(False))
    return stats.select("doc_id", *carry, *COUNTS, "base_failed", verdict.alias("kept"))
