"""Exact deduplication by composable polynomial fingerprints.

A text is normalised by deleting the six ASCII white-space characters, cut into
chunks, and each chunk is hashed as a polynomial modulo three 31-bit primes.  Two
neighbouring pieces compose without being read again::

    H(a || b) = H(a) * base ** len(b) + H(b)

so pieces of a huge text are hashed by different tasks and folded afterwards.
Texts with equal (fingerprint, length) are then compared chunk by chunk.  The
comparison is an aggregation keyed by the chunk's bytes: identical chunks
collapse before the shuffle, so a group that holds a third of all rows moves no
more than one row per chunk and task.  A fingerprint whose members differ
somewhere is a collision; its members are told apart by their digests.

Defined results: a null text counts as empty, and all empty texts are equal.
Very long texts are hashed in pieces.  A null id sorts after every other id.
Exactly one row of a group is kept; of rows tied in code points and id it is any
one.  An empty table gives no rows.  Other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import BATCH_BYTES, as_bytes, bounded, checkpoint, map_batches, maybe_broadcast

SPACE = b" \t\n\x0b\x0c\r"
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (911382323, 972663749, 1367130551)
CHUNK = 1 << 16
#: Bytes from which a text is hashed by several tasks.
HUGE = 1 << 22
FP = ["h0", "h1", "h2", "norm_len"]
_POWERS: dict[int, np.ndarray] = {}


def _powers(k: int, primes=PRIMES) -> np.ndarray:
    """base**(CHUNK-1) ... base**0 for modulus ``k``."""
    key = (k, primes)
    if key not in _POWERS:
        out, x = np.empty(CHUNK, dtype=np.uint64), 1
        for i in range(CHUNK - 1, -1, -1):
            out[i] = x
            x = x * BASES[k] % primes[k]
        _POWERS[key] = out
    return _POWERS[key]


def chunk_hash(data: bytes, primes=PRIMES) -> tuple[int, ...]:
    """Hashes of one chunk; bytes count from 1 so that leading zeros matter."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    # 2**16 terms below 2**31 * 2**9 stay under 2**56
    return tuple(int(np.dot(x, _powers(k, primes)[CHUNK - len(x) :]) % primes[k]) for k in range(3))


def compose(left: tuple[int, ...], right: tuple[int, ...], right_len: int, primes=PRIMES) -> tuple[int, ...]:
    """Hashes of a || b from those of a and b: shift a by the length of b, add b."""
    return tuple((a * pow(BASES[k], right_len, primes[k]) + b) % primes[k] for k, (a, b) in enumerate(zip(left, right, strict=True)))


def fingerprint(data: bytes, primes=PRIMES) -> tuple[int, ...]:
    """Hashes of a whole text, folded over its chunks."""
    acc = (0, 0, 0)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        acc = compose(acc, chunk_hash(part, primes), len(part), primes)
    return acc


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, huge: int = HUGE, primes=PRIMES) -> DataFrame:
    """row, doc_id, n_chars, h0, h1, h2, norm_len, sha for each row, written out; ``row`` numbers the rows.

    The table is read once.  A text of more than ``huge`` bytes leaves that pass
    in pieces, which are hashed in parallel and folded.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    src = df.select(F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row"), as_bytes(text).alias("__text"))
    names = ["doc_id", "n_chars", "row", "piece", "h0", "h1", "h2", "norm_len", "sha", "data"]
    types = [None, pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.binary()]

    def made(rows, like):
        types[0] = like.schema.field("doc_id").type
        return pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, t, v in zip(names, types, zip(*rows, strict=True), strict=True)})

    def run(batches):
        for batch in batches:
            out, held = [], 0
            ids, sizes, nums = (batch.column(c).to_pylist() for c in ("doc_id", "n_chars", "row"))
            for i, n, k, raw in zip(ids, sizes, nums, batch.column("__text"), strict=True):
                raw = raw.as_py()  # one text at a time
                if len(raw) <= huge:
                    raw = raw.translate(None, SPACE)
                    out.append((i, n, k, None, *fingerprint(raw, primes), len(raw), hashlib.sha256(raw).hexdigest(), None))
                    continue
                sha, first = hashlib.sha256(), len(out)
                for piece, at in enumerate(range(0, len(raw), huge)):
                    part = raw[at : at + huge].translate(None, SPACE)
                    sha.update(part)
                    out.append((i, n, k, piece, None, None, None, len(part), None, part))
                    held += len(part)
                out[first] = (*out[first][:8], sha.hexdigest(), out[first][9])
                if held > huge:
                    yield made(out, batch)
                    out, held = [], 0
            if out:
                yield made(out, batch)

    found = checkpoint(bounded(src).mapInArrow(run, f"doc_id {kind}, n_chars long, row long, piece int, h0 long, h1 long, h2 long, norm_len long, sha string, data binary"))
    keep = ["row", "doc_id", "n_chars", *FP, "sha"]
    big = found.filter("piece is not null")
    if big.isEmpty():
        return found.select(*keep)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(x.as_py(), primes) for x in batch.column("data")]
        cols = {n: batch.column(n) for n in names if n not in ("h0", "h1", "h2", "data")}
        return pa.RecordBatch.from_pydict(cols | {f"h{k}": pa.array([p[k] for p in prints], pa.int64()) for k in range(3)})

    pieces = map_batches(big.repartition("row", "piece"), hashed, f"doc_id {kind}, n_chars long, row long, piece int, norm_len long, sha string, h0 long, h1 long, h2 long")
    return checkpoint(found.filter("piece is null").select(*keep).unionByName(_fold_pieces(pieces, primes).select(*keep)))


def _fold_pieces(pieces: DataFrame, primes) -> DataFrame:
    """One row per text from the hashes of its pieces (a few numbers per piece of ``HUGE`` bytes)."""

    def run(part):
        rows = sorted(part.to_pylist(), key=lambda r: r["piece"])
        acc, n = (0, 0, 0), 0
        for r in rows:
            acc, n = compose(acc, (r["h0"], r["h1"], r["h2"]), r["norm_len"], primes), n + r["norm_len"]
        r = rows[0]
        out = {"row": [r["row"]], "doc_id": [r["doc_id"]], "n_chars": [r["n_chars"]], "h0": [acc[0]], "h1": [acc[1]], "h2": [acc[2]], "norm_len": [n], "sha": [r["sha"]]}
        return pa.table({k: pa.array(v, part.schema.field(k).type) for k, v in out.items()})

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.groupBy("row").applyInArrow(run, f"row long, doc_id {kind}, n_chars long, h0 long, h1 long, h2 long, norm_len long, sha string")


def collisions(df: DataFrame, prints: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints under which texts differ, by comparing the chunks of all texts that share one."""
    shared = checkpoint(prints.groupBy(*FP).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    shared = maybe_broadcast(shared, shared.count(), 64)
    # Grouped by one struct, so that the rows of a hot fingerprint are dealt out again by their ids.
    members = prints.join(shared, FP, "left_semi").select(F.struct("doc_id", *FP).alias("m")).distinct()
    members = checkpoint(members.select("m.*"))
    members = maybe_broadcast(members, members.count(), 48)
    texts = df.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("__text"))
    named = texts.join(members, texts.doc_id.eqNullSafe(members.doc_id)).select(*FP, "__text")

    def made(seen):
        return pa.RecordBatch.from_pydict({
            **{c: pa.array([k[i] for k in seen], pa.int64()) for i, c in enumerate(FP)},
            "chunk": pa.array([k[4] for k in seen], pa.int64()), "bytes": pa.array([k[5] for k in seen], pa.binary()),
        })

    def run(batches):
        for batch in batches:
            seen, held = {}, 0  # copies in a batch give their chunks once
            for *key, raw in zip(*(batch.column(c).to_pylist() for c in FP), batch.column("__text"), strict=True):
                data = raw.as_py().translate(None, SPACE)
                if len(data) != key[3]:
                    continue  # an id repeated with another text is no member
                for at in range(0, len(data), CHUNK):
                    part = (*key, at // CHUNK, data[at : at + CHUNK])
                    if part not in seen:
                        seen[part] = None
                        held += len(part[5])
                if held > BATCH_BYTES:
                    yield made(seen)
                    seen, held = {}, 0
            yield made(seen)

    chunks = bounded(named).mapInArrow(run, "h0 long, h1 long, h2 long, norm_len long, chunk long, bytes binary")
    distinct = chunks.groupBy(*FP, "chunk", "bytes").agg(F.lit(1).alias("one"))
    return distinct.groupBy(*FP, "chunk").agg(F.count("*").alias("texts")).filter("texts > 1").select(*FP).distinct()


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, huge: int = HUGE, primes=PRIMES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then the smallest id.
    """
    prints = fingerprints(df, doc_id, text, huge=huge, primes=primes)
    # The row's number makes the row that stays one of those that repeat an id.
    first = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("row"))
    groups = prints.groupBy(*FP, "sha").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    # Texts under a fingerprint without a collision are equal, whatever their digests would say.
    clash = collisions(df, prints, doc_id, text).withColumn("clash", F.lit(True))
    groups = groups.join(clash, FP, "left").withColumn("part", F.when(F.col("clash"), F.col("sha")).otherwise(F.lit("")))
    classes = groups.groupBy(*FP, "part").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"), F.collect_set("sha").alias("shas"))
    # Written out, so that the last join has plain exchanges on both sides and a hot group can be split.
    classes = checkpoint(classes.select(*FP, F.explode("shas").alias("sha"), F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"))
    return prints.join(classes, [*FP, "sha"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
