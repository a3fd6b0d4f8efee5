"""Language identification by nearest centroid.

A text is a vector of byte-trigram counts, damped by a logarithm, weighted by
inverse document frequency and scaled to length one.  The vectors of each
language in a sample are clustered (spherical k-means), which gives several
centroids a language; a text takes the language of the centroid with the largest
cosine.  A text whose cosine is below almost all of its language's own sample
is marked ``rejected``: it is too far from everything known.

Trigrams are taken over bytes with A-Z lower-cased and runs outside letters
blank.  Fitting reads a bounded sample: the ``per_lang`` smallest hashes of a
language in expectation, at most twice that over all, of texts of ``min_chars``
to ``max_chars``; a language without such gives its other texts that hold a
letter, cut at ``max_chars``.  Prediction reads every text whole.

Defined results: ``und`` for a null text and one without a letter, score 0.
Without any labelled text every row is ``und``.  Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import fold, map_batches

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Bytes of text turned into counts at a time.
STEP = 1 << 20


def has_letter(text: bytes) -> bool:
    return _ASCII_LETTER.search(text) is not None or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def trigrams(text: bytes) -> np.ndarray:
    """24-bit codes of the byte trigrams of the folded text, a blank before and after it."""
    a = np.frombuffer(b" " + text.translate(_FOLD) + b" ", dtype=np.uint8).astype(np.int32)
    return (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]


@dataclass(frozen=True)
class Model:
    codes: np.ndarray  # sorted trigram codes, the features
    idf: np.ndarray
    centroids: np.ndarray  # features x centroids
    lang_of: tuple[int, ...]  # language of each centroid
    langs: tuple[str, ...]
    floor: tuple[float, ...]  # least cosine of each language

    def table(self) -> np.ndarray:
        """Feature number by trigram code; the last number stands for all other codes."""
        out = np.full(1 << 24, len(self.codes), dtype=np.int16)
        out[self.codes] = np.arange(len(self.codes), dtype=np.int16)
        return out


def vectors(texts: list[bytes], table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors (texts x features)."""
    n = len(idf)
    out = np.zeros((len(texts), n), dtype=np.float32)
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t)), STEP):  # neighbours of a cut are read by both sides
            out[i] += np.bincount(table[trigrams(t[max(0, at - 1) : at + STEP + 1])], minlength=n + 1)[:n]
    out = np.log1p(out) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit(rows: list[tuple[bytes, str]], *, features: int = 4096, clusters: int = 4, quantile: float = 0.005) -> Model | None:
    """A model from (text, language) rows in a fixed order; None without rows."""
    if not rows:
        return None
    langs = tuple(sorted({lang for _, lang in rows}))
    seen: dict[str, np.ndarray] = {}
    for lang in langs:
        own = [np.unique(trigrams(t)) for t, x in rows if x == lang]
        codes, counts = np.unique(np.concatenate(own), return_counts=True)
        seen[lang] = np.stack([codes, counts])
    share = max(1, features // len(langs))
    codes = np.unique(np.concatenate([c[np.lexsort((c, -k))][:share] for c, k in seen.values()]))
    df = np.zeros(len(codes))
    for c, k in seen.values():
        at = np.searchsorted(codes, c)
        ok = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == c)
        df[at[ok]] += k[ok]
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    model = Model(codes, idf, np.zeros((len(codes), 0), np.float32), (), langs, ())
    table = model.table()
    centroids, lang_of, floor = [], [], []
    for k, lang in enumerate(langs):
        x = vectors([t for t, y in rows if y == lang], table, idf)
        c = _cluster(x, clusters)
        centroids.append(c)
        lang_of += [k] * len(c)
        floor.append(float(np.quantile((x @ c.T).max(axis=1), quantile)))
    return Model(codes, idf, np.concatenate(centroids).T.copy(), tuple(lang_of), langs, tuple(floor))


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-point starts."""
    c = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        c.append(x[np.argmin((x @ np.stack(c).T).max(axis=1))])
    c = np.stack(c)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].mean(axis=0) for j in range(len(c)) if (near == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def training_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *, per_lang: int = 400, max_chars: int = 16384, min_chars: int = 20) -> list[tuple[bytes, str]]:
    """The bounded sample of (text, language), outside the held-out fold, ordered by hash."""
    size = F.length(F.col(text))
    fits = size.between(min_chars, max_chars)
    known = df.filter(F.col(lang).isNotNull() & (fold(doc_id) != 2) & (fits | F.rlike(F.col(text), F.lit(r"\p{L}")))).select(
        F.col(lang).alias("lang"), F.substring(F.col(text), 1, max_chars).cast("binary").alias("t"), F.xxhash64(F.col(doc_id)).alias("h"), fits.alias("fits")
    )
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("fits").alias("fit")).collect()  # two numbers a language
    if not found:
        return []
    counts = {r["lang"]: r["fit"] or r["n"] for r in found}
    if other := [r["lang"] for r in found if not r["fit"]]:
        known = known.filter(F.col("fits") | F.col("lang").isin(other))
    else:
        known = known.filter("fits")
    # A language keeps the hashes below its share of the range.
    share = F.create_map(*(F.lit(v) for x, n in sorted(counts.items()) for v in (x, min(1.0, per_lang / n))))
    keep = F.col("h").cast("double") < (share[F.col("lang")] * 2 - 1) * float(2**63)
    rows = known.filter(keep).orderBy("h", "lang", "t").limit(2 * per_lang * len(counts)).collect()
    return [(bytes(r["t"]), r["lang"]) for r in rows]


def predict(df: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected."""
    blob = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = blob.value, batch.column("__text").to_pylist()
        lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        known = [i for i, t in enumerate(texts) if t and m is not None and has_letter(t)]
        table = _tables(m) if known else None
        for at in range(0, len(known), 64):
            rows = known[at : at + 64]
            cos = vectors([texts[i] for i in rows], table, m.idf) @ m.centroids
            best = cos.argmax(axis=1)
            for i, b, c in zip(rows, best, cos.max(axis=1), strict=True):
                k = m.lang_of[b]
                lang[i], score[i], far[i] = m.langs[k], min(1.0, max(0.0, float(c))), bool(c < m.floor[k])
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(lang), "score": pa.array(score), "rejected": pa.array(far)})

    kind = df.schema[doc_id].dataType.simpleString()
    cols = df.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == 2).alias("held_out"), F.col(text).cast("binary").alias("__text"))
    return map_batches(cols, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


_LAST: list = [None, None]


def _tables(model: Model) -> np.ndarray:
    """The worker's lookup table, built once for the model it serves."""
    if _LAST[0] is not model:
        _LAST[:] = [model, model.table()]
    return _LAST[1]


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **sample) -> DataFrame:
    """Fit on the labelled sample outside the held-out fold, then predict every row."""
    return predict(df, fit(training_rows(df, doc_id, text, lang, **sample)), doc_id, text)
