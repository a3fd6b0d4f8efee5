"""Compression classifier of text quality.

One zstandard dictionary is trained on good and one on bad labelled texts.  A
text is compressed, in pieces, with each; the normalised difference of the two
sizes says which class it resembles, and a logistic calibration fitted on other
labelled texts turns it into a probability.  The calibration also sees how far
the text compresses at all, as a text of few distinct words leaves little
difference to see.  Pieces keep the dictionaries in reach of the match window in
long texts.

Fitting reads a bounded sample: at most ``per_class`` texts a class for the
dictionaries and ``calibrate`` others, the smallest by hash of the id, none over
``max_chars``.  Scoring reads every text whole.

Defined results: a null text counts as empty; an empty text gets the base rate
of the sample.  Without labels of both classes every score is that rate (0.5
without any label).  Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import as_bytes, fold, map_batches

DICT_BYTES, LEVEL, PIECE = 112_640, 3, 4096


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    rate: float

    def sizes(self):
        """A function from a text to its compressed sizes under the good and the bad dictionary."""
        packs = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress for d in (self.good, self.bad)]

        def run(text: bytes) -> tuple[int, int]:
            good = bad = 0
            for at in range(0, len(text), PIECE):
                part = text[at : at + PIECE]
                good, bad = good + len(packs[0](part)), bad + len(packs[1](part))
            return good, bad

        return run

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.rate)
        run = self.sizes()
        x = np.array([(*run(t), len(t)) for t in texts], dtype=float).reshape(-1, 3)
        p = 1 / (1 + np.exp(-np.clip(_design(x) @ np.array(self.weights), -35, 35)))
        return np.where(x[:, 2] > 0, p, self.rate)


def _design(x: np.ndarray) -> np.ndarray:
    """Calibration inputs of (good size, bad size, length) rows."""
    good, bad, n = x.T
    diff = 20 * (bad - good) / np.maximum(bad + good, 1)
    rate = np.minimum(good, bad) / np.maximum(n, 1)
    return np.c_[np.ones(len(x)), diff, np.minimum(diff, 0.2), rate, rate**2]


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their contents serve as they are
        return b"\n".join(texts)[-DICT_BYTES:]


def fit(rows: list[tuple[int, bytes, int]]) -> Model:
    """A model from (part, text, label) rows: part 0 feeds the dictionaries, part 1 the calibration."""
    labels = [y for _, _, y in rows]
    rate = float(np.mean(labels)) if labels else 0.5
    by = [[t for p, t, y in rows if p == 0 and y == k and t] for k in (0, 1)]
    rest = [(t, y) for p, t, y in rows if p == 1 and t]
    if not all(by) or len({y for _, y in rest}) < 2:
        return Model(b"", b"", (), rate)
    model = Model(_dictionary(by[1]), _dictionary(by[0]), (0.0,), rate)
    run = model.sizes()
    x, y = _design(np.array([(*run(t), len(t)) for t, _ in rest], dtype=float)), np.array([v for _, v in rest], dtype=float)
    w, ridge = np.zeros(x.shape[1]), 1e-2
    for _ in range(40):  # Newton's method, damped by the ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return Model(model.good, model.bad, tuple(map(float, w)), rate)


def training_rows(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", *, quality: str = "quality", per_class: int = 1000, calibrate: int = 6000, max_chars: int = 16384) -> list[tuple[int, bytes, int]]:
    """The bounded sample, with the held-out fold left out."""
    known = labels.filter(F.col(quality).isin(0, 1) & (fold(doc_id) != 2)).select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("int").alias("y"), F.xxhash64(F.col(doc_id)).alias("h"))
    part = F.pmod(F.col("h"), F.lit(2)).cast("int")
    picks = [known.filter((part == 0) & (F.col("y") == k)).orderBy("h").limit(per_class) for k in (0, 1)]
    picks.append(known.filter(part == 1).orderBy("h").limit(calibrate))
    chosen = {r["doc_id"]: (r["p"], r["y"]) for p in picks for r in p.select("doc_id", part.alias("p"), "y").collect()}
    if not chosen:
        return []
    spark = df.sparkSession
    ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen], f"doc_id {df.schema[doc_id].dataType.simpleString()}"))  # at most 2 * per_class + calibrate ids
    texts = df.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("t")).filter(F.length(F.col("t")) <= 4 * max_chars).join(ids, "doc_id")
    rows = sorted({(r["doc_id"], bytes(r["t"])) for r in texts.filter(F.length(F.col("t").cast("string")) <= max_chars).collect()})
    return [(chosen[i][0], t, chosen[i][1]) for i, t in rows]


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", *, cutoff: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    blob = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = blob.value.scores(batch.column("__text").to_pylist())
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(s), "predicted": pa.array((s >= cutoff).astype(np.int32))})

    kind = df.schema[doc_id].dataType.simpleString()
    return map_batches(df.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == 2).alias("held_out"), as_bytes(text).alias("__text")), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def quality_scores(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **sample) -> DataFrame:
    """Fit on the labelled sample outside the held-out fold, then score every row."""
    return score(df, fit(training_rows(df, labels, doc_id, text, **sample)), doc_id, text)
