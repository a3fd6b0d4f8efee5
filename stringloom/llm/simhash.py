"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius.

Fingerprints come from word shingles.  Equal fingerprints collapse first.  Two
fingerprints within radius ``r`` agree on at least one choice of ``blocks - r``
of ``blocks`` bit blocks, so each is listed under every such choice, and only
lists are compared.  Inside a list the comparison is bit-sliced: fingerprints
lie in 64-lane words as vertical bit planes, a query is compared with 64 lanes by
one XOR per plane, distances accumulate in carry-save bitwise counters, and a
(query, word) pair is abandoned once all its lanes are beyond the radius.  Each
list yields a spanning forest, never its pairs; components are then distributed.

Lists longer than ``limit`` are cut into slices, and each pair of slices is a
list of its own: exact at any size, with bounded memory in every task.

Defined results: a null or blank text has fingerprint zero, which links like any
other.  ``component_id`` is the smallest non-null id of the component.  Rows that
repeat an id are rows like any other; other input columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import as_bytes, checkpoint, map_batches, maybe_broadcast
from stringloom.llm.graph import components

ONE = np.uint64(1)
LANES = np.uint64(0x0101010101010101)
#: Rows summed in byte-wide lanes before they are widened.
RUN = 255
#: Fingerprints that one list may hold before it is cut into slices.
LIMIT = 4096
#: (Query, word) pairs compared at a time.
TASKS = 1 << 15


def shingles(text: bytes, n: int) -> list[bytes]:
    """Space-joined ``n``-word shingles of ``text``, lower-cased in A-Z; fewer words give one."""
    words = text.lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [flat[s : e - 1] for s, e in zip(starts, ends[n - 1 :], strict=False)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bitwise majority of each run of ``sizes`` hashes; an empty run gives zero."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    if not len(hashes):
        return out
    ends = np.cumsum(sizes)
    pieces = -(-sizes // RUN)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = (ends - sizes)[owner] + nth * RUN
    counts = np.zeros((len(sizes), 8, 8), dtype=np.int64)  # text, byte of the word, bit of the byte
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, at)
        np.add.at(counts[:, :, bit], owner, lanes.view(np.uint8).reshape(-1, 8).astype(np.int64))
    return np.packbits(counts.reshape(-1, 64) * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, parts, digest = [], [], xxhash.xxh64_intdigest
        for raw in batch.column("__text"):
            own = [digest(x, seed) for x in shingles(raw.as_py(), words)]
            sizes.append(len(own))
            parts.append(np.array(own, dtype=np.uint64))
        fp = majority(np.concatenate(parts), np.array(sizes, dtype=np.int64))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))})

    kind = df.schema[doc_id].dataType.simpleString()
    return map_batches(df.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("__text")), run, f"doc_id {kind}, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane b, word w holds bit b of the fingerprints 64w ... 64w+63."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, 64), dtype=np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def lanes_within(planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (query, word) pairs with eligible ``lanes``: those with lanes within ``radius`` (0 to 3), and these lanes."""
    at = np.arange(len(query))
    ones, twos, over = (np.zeros(len(query), dtype=np.uint64) for _ in range(3))
    for b in range(0, 64, 2):
        x, y = (planes[p][word] ^ -((query >> np.uint64(p)) & ONE) for p in (b, b + 1))
        half = ones ^ x
        carry = (ones & x) | (half & y)
        ones = half ^ y
        over |= twos & carry
        twos ^= carry
        if b % 8 == 6:
            live = (lanes & ~over) != 0
            if not live.all():  # every lane of the others is beyond the radius
                at, query, word, lanes, ones, twos, over = (v[live] for v in (at, query, word, lanes, ones, twos, over))
            if not len(at):
                break
    far = over | {3: np.uint64(0), 2: ones & twos, 1: twos, 0: ones | twos}[radius]
    lanes = lanes & ~far
    return at[lanes != 0], lanes[lanes != 0]


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits in every lane."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def lanes_within_any(planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``lanes_within`` for any radius: eight planes at a time go through a carry-save tree into seven counters."""
    at, count = np.arange(len(query)), [np.zeros(len(query), dtype=np.uint64) for _ in range(7)]
    for b in range(0, 64, 8):
        x = [planes[p][word] ^ -((query >> np.uint64(p)) & ONE) for p in range(b, b + 8)]
        fours = []
        for k in (0, 4):
            count[0], t = _add(count[0], x[k], x[k + 1])
            count[0], u = _add(count[0], x[k + 2], x[k + 3])
            count[1], f = _add(count[1], t, u)
            fours.append(f)
        count[2], carry = _add(count[2], *fours)
        for k in range(3, 7):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over, equal = np.zeros_like(lanes), ~np.zeros_like(lanes)
        for k in range(6, -1, -1):  # lanes whose count exceeds the radius
            if radius >> k & 1:
                equal = equal & count[k]
            else:
                over, equal = over | (equal & count[k]), equal & ~count[k]
        lanes = lanes & ~over
        if b >= radius:  # whole words may be beyond it
            live = lanes != 0
            if not live.all():
                at, query, word, lanes = at[live], query[live], word[live], lanes[live]
                count = [c[live] for c in count]
            if not len(at):
                break
    return at[lanes != 0], lanes[lanes != 0]


def _tasks(end: np.ndarray, tasks: int = TASKS):
    """(query, word, eligible lanes), some ``tasks`` at a time, to compare every i with i + 1 ... end[i] - 1."""
    lane = np.arange(len(end))
    has = np.flatnonzero(end > lane + 1)
    first, last = (has + 1) // 64, (end[has] - 1) // 64
    upto = np.cumsum(last - first + 1)
    low = 0
    while low < len(has):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + tasks, "right")))
        reps = (last - first + 1)[low:high]
        q = np.repeat(has[low:high], reps)
        w = np.repeat(first[low:high], reps) + np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
        a, z = np.maximum(q + 1 - w * 64, 0), np.minimum(end[q] - w * 64, 64)  # eligible lanes a ... z-1
        yield q, w, (np.uint64(0xFFFFFFFFFFFFFFFF) << a.astype(np.uint64)) & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - z).astype(np.uint64))
        low = high


def _pairs(query: np.ndarray, word: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, position) of every lane that is set."""
    t, k = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[t], word[t] * 64 + k


def near_parts(fps: np.ndarray, end: np.ndarray, radius: int, every: np.ndarray, tasks: int = TASKS >> 3):
    """Pairs (i, j), i < j < end[i], of fingerprints within ``radius``, and all such pairs with i or j in ``every``; at most 64 ``tasks`` at a time, or those of one i."""
    planes = planes_of(fps)
    some = np.zeros(planes.shape[1] * 64, dtype=np.uint8)
    some[: len(every)] = every
    some = np.packbits(some, bitorder="little").view(np.uint64)
    for q, w, lanes in _tasks(end, tasks):
        near = np.where(every[q], lanes, lanes & some[w])
        hit, own = lanes_within_any(planes, fps[q], w, lanes, radius)
        near[hit] |= own
        yield _pairs(q, w, near)


def near_lanes(fps: np.ndarray, end: np.ndarray, radius: int, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of ``near_parts`` at once, for short lists."""
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(v) for v in zip((none, none), *near_parts(fps, end, radius, every), strict=True))


def forest(fps: np.ndarray, group: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest of the links inside each run of equal ``group``."""
    change = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    end = np.repeat(change[1:], np.diff(change))
    lane, root = np.arange(len(fps)), np.arange(len(fps))
    planes = planes_of(fps)
    for q, w, ok in _tasks(end):
        hit, lanes = lanes_within(planes, fps[q], w, ok, radius)
        _hook(root, *_pairs(q[hit], w[hit], lanes))
    own = np.flatnonzero(root != lane)
    return own, root[own]


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the trees of ``root`` along the links (i, j), smaller root first, and flatten them."""
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _choices(distinct: int, radius: int) -> list[int]:
    """Bit masks, one for each choice of blocks that must agree; finer as the corpus grows."""
    blocks = radius + 1 + (distinct > 1 << 22) + (distinct > 1 << 28)
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def links(nodes: DataFrame, *, radius: int = 3, limit: int = LIMIT, distinct: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all of the distinct longs ``nodes.fp`` within ``radius`` bits of each other."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = _choices(nodes.count() if distinct is None else distinct, radius)
    listed = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks))).alias("mask", "part"))
    sizes = listed.groupBy("mask", "part").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    sizes = checkpoint(sizes.select("mask", "part", F.ceil(F.col("n") / limit).cast("int").alias("slices")))
    sizes = maybe_broadcast(sizes, sizes.count(), 24)
    listed = listed.join(sizes, ["mask", "part"], "left").withColumn("s", F.coalesce("slices", F.lit(1)))
    mine = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("s")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("s") - 1))
    listed = listed.select("mask", "part", "fp", mine.alias("mine"), other.alias("other"))
    key = F.xxhash64("mask", "part", F.least("mine", "other"), F.greatest("mine", "other"))
    # Two lists that met under one key would only be compared needlessly.
    listed = listed.select(key.alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(k, f):
            if len(f) > 1:
                i, j = forest(f, k, radius)
                if len(i):
                    f = f.view(np.int64)
                    yield pa.RecordBatch.from_pydict({"a": pa.array(f[i]), "b": pa.array(f[j])})

        for batch in batches:
            keys = np.r_[keys, batch.column("key").to_numpy()]
            fps = np.r_[fps, batch.column("fp").to_numpy().view(np.uint64)]
            if len(keys):
                cut = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
                yield from found(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield from found(keys, fps)

    return listed.mapInArrow(run, "a long, b long")


def similar_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, component_id, of texts linked at a Jaccard similarity instead of a radius; see ``near_copies``."""
    from stringloom.llm.near_copies import near_copies

    return near_copies(df, doc_id, text, words=words, similarity=similarity)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 3, seed: int = 42, radius: int = 3, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    docs = checkpoint(fingerprints(df, doc_id, text, words=words, seed=seed))
    nodes = checkpoint(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(links(nodes, radius=radius, limit=limit))
    # Written out before each join, so that it has plain exchanges on both sides and a hot key can be split.
    named = checkpoint(nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = checkpoint(named.groupBy("root").agg(F.min("first").alias("component_id")))
    named = checkpoint(named.join(least, "root").select("fp", "component_id"))
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
