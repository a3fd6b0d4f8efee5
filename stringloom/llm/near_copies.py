"""Near copies: SimHash comparison of texts with a similarity of word-shingle sets.

This is the SimHash operator for a similarity instead of a radius.  At a Jaccard
similarity of 0.8 some ten of 64 bits differ, and no choice of agreeing blocks
finds such fingerprints without listing every text hundreds of times.  So texts
are listed by bands of min-hashes of their shingles (16 bands of three: a pair at
0.8 shares no list once in 45,000), fingerprints are compared bit-sliced inside
lists, within a radius that a similar pair exceeds once in 100,000, and what is
left is verified on whole sets.

No list is expanded to its pairs.  Every text under a key is compared with the
first one, verified links are made classes, and only lists whose texts are not
all in one class go on: every text meets the first and the one before it in an
order of the key's own, then, in rounds, the nearest fingerprint of another class,
found bit by bit in slices of bounded size.  So the pairs that are verified grow
with the texts.  Where a list has texts of several classes even then, all of its
texts of different classes are compared, in pairs of slices, by the exact sizes of
common sets from a matrix product; pairs are no rows there.  So two similar
texts end in one class unless they share no list at all.

Defined results: a text of fewer words than a shingle is one shingle; a null
counts as empty, and a blank text has none.  Equal texts, repeated rows among
them, collapse first.  Long texts are read in stretches.  A component is named by
its smallest id, so ties do not arise; an empty table gives no rows, and other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm import simhash
from stringloom.llm.common import bounded, checkpoint, map_batches, maybe_broadcast, named_texts, release
from stringloom.llm.graph import components, extended, forest
from stringloom.llm.passages import LIMIT as PART
from stringloom.llm.passages import RECENT, ROWS, _within, in_blocks, linked, overlaps, shingle_hashes, stretches

WORDS, SIMILARITY = 5, 0.8
BANDS, MINIMA = 16, 3
#: Bits of 64 that may differ, and the shingles below which fingerprints say too little.
RADIUS, FEW = 22, 40
#: Comparisons with the nearest, before all that is still apart is compared.
ROUNDS = 2
#: Texts of a slice of a list.
LIMIT = 2048
#: Texts whose keys meet before they are sent.
HELD = 8192
_EPS = 1e-9
_MULTIPLY, _FLIP = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * MINIMA, 1), dtype=np.uint64)
_MULTIPLY |= np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    own = []
    for start, w in stretches(text, words):
        if start == 0 and len(w):
            own.append(shingle_hashes(w, min(words, len(w))))
        elif len(w) >= words:
            own.append(shingle_hashes(w, words))
    return np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band of a set that is not empty."""
    least = np.full(BANDS * MINIMA, np.uint64(2**64 - 1))
    for at in range(0, len(s), 1024):
        least = np.minimum(least, ((s[at : at + 1024] ^ _FLIP) * _MULTIPLY).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, MINIMA).T:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(node, n, fp, keys) of every text that has a shingle; copies may give several equal rows."""

    def run(batches):
        recent = set()
        for batch in batches:
            nodes, sets = [], []
            for node, x in zip(batch.column("node").to_pylist(), batch.column("__text"), strict=True):
                if node in recent:
                    continue
                if len(recent) >= RECENT:
                    recent.clear()
                recent.add(node)
                if len(s := shingle_set(x.as_py(), words)):
                    nodes.append(node)
                    sets.append(s)
            if nodes:
                n = np.array([len(s) for s in sets])
                fp = simhash.majority(np.concatenate(sets), n)
                keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "n": pa.array(n, pa.int32()), "fp": pa.array(fp.view(np.int64)), "keys": keys})

    return bounded(docs.select("node", "__text")).mapInArrow(run, "node long, n int, fp long, keys array<long>")


def _listed(rows: DataFrame, near: bool) -> DataFrame:
    """Links under common keys, as (key, a, ca, b, cb) with the sizes of the sets, of rows (key, node, n); ``key`` may be an array."""

    def run(batches):
        parts, size = [], 0

        def flush():
            yield from _within(*(np.concatenate(v) for v in zip(*parts, strict=True)), near)
            parts.clear()

        for batch in batches:
            node, n, key = batch.column("node").to_numpy(), batch.column("n").to_numpy(), batch.column("key")
            if pa.types.is_list(key.type):
                times = np.diff(key.offsets.to_numpy())
                node, n, key = np.repeat(node, times), np.repeat(n, times), key.flatten()
            parts.append((key.to_numpy(), node, n))
            size += len(node)
            if size >= BANDS * HELD:
                yield from flush()
                size = 0
        if parts:
            yield from flush()

    return linked(bounded(rows).mapInArrow(run, ROWS), near=near)


def sets_of(ends: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, s, repeats): the shingle sets of the texts in the distinct ``ends`` (node); one document is read for each text."""
    named = checkpoint(nodes.join(ends, "node").select("node", "first", "repeats"))
    wanted = maybe_broadcast(named.select(F.col("node").alias("node2"), F.col("first").alias("id2"), "repeats"), named.count(), 24)
    texts = docs.join(wanted, (docs.node == wanted.node2) & docs.doc_id.eqNullSafe(wanted.id2)).select("node", "__text", "repeats")

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingle_set(x.as_py(), words).tobytes() for x in batch.column("__text")]
        return pa.RecordBatch.from_pydict({"node": batch.column("node"), "s": pa.array(own, pa.binary()), "repeats": batch.column("repeats")})

    sets = checkpoint(map_batches(texts, made, "node long, s binary, repeats boolean"))
    if not (again := sets.filter("repeats")).isEmpty():  # an id repeated with its text
        sets = checkpoint(sets.filter("not repeats").unionByName(again.dropDuplicates(["node"])))
    return sets


def across(lists: DataFrame, sets: DataFrame, similarity: float, limit: int) -> DataFrame:
    """Pairs (a, b) of roots that similar texts join, of all texts of different classes under one key.

    ``lists`` holds (key, node, n, root), ``sets`` (node, s).  Keys that the same
    texts have are one list; each two slices of a list give a forest.
    """
    same = F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(1), "node")))
    own = lists.join(lists.groupBy("key").agg(same.alias("list")), "key").groupBy("list", "node").agg(F.min("n").alias("n"), F.min("root").alias("root"))
    own = own.join(sets.select("node", "s").hint("merge"), "node")

    def run(block, mask):
        root = block.column("root").to_numpy()
        s = [np.frombuffer(x.as_py(), np.uint64) for x in block.column("s")]
        size = np.array([len(x) for x in s])
        near = mask & (root[:, None] != root) & (overlaps(s) * (1 + similarity) >= similarity * (size[:, None] + size) - 1e-6)
        i, j = np.nonzero(near)
        if len(i):
            a, b = forest(root[i], root[j])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[a != b]), "b": pa.array(b[a != b])})

    return in_blocks(own, "list", "n", run, "a long, b long", limit)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose sets are similar; one document is read for each text."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, nodes, words)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(common >= similarity * (len(x) + len(y) - common) - _EPS)
        ok = pa.array(ok, pa.bool_())
        return pa.RecordBatch.from_pydict({"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok)})

    return checkpoint(map_batches(both, kept, "a long, b long"))


def apart(lists: DataFrame, similarity: float, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of texts of different classes under one key: each text's nearest, if fingerprint and sizes allow the similarity.

    ``lists`` holds (key, node, n, fp, root).  The comparison is bit-sliced; a
    list is cut into slices, and each two slices are a list of their own.  A text
    gives a pair at most a list, and over all lists one.
    """
    sizes = lists.groupBy("key").agg(F.ceil(F.count("*") / limit).cast("int").alias("slices")).filter("slices > 1")
    cut = lists.join(sizes, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("slices"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)))
    cut = cut.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node", "n", "fp", "root")

    def pairs(key, node, n, fp, root):
        end = np.repeat(np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1, np.diff(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])))
        best, other = np.full(len(node), 127, np.int32), np.zeros_like(node)
        # A list has up to half its square of near pairs; only the nearest of each text outlives a part of them.
        for i, j in simhash.near_parts(fp.view(np.uint64), end, RADIUS, n < FEW):
            ok = (root[i] != root[j]) & (node[i] != node[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - _EPS)
            i, j = np.r_[i[ok], j[ok]], np.r_[j[ok], i[ok]]
            far = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)).astype(np.int32)
            order = np.lexsort((node[j], far, i))
            i, j, far = i[order], node[j[order]], far[order]
            ok = np.r_[True, i[1:] != i[:-1]][: len(i)]
            i, j, far = i[ok], j[ok], far[ok]
            ok = (far < best[i]) | (far == best[i]) & (j < other[i])
            best[i[ok]], other[i[ok]] = far[ok], j[ok]
        has = best < 127
        return pa.RecordBatch.from_pydict({"node": pa.array(node[has]), "far": pa.array(best[has]), "other": pa.array(other[has])})

    names = ("key", "node", "n", "fp", "root")

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            held = cols if held is None else [np.r_[a, b] for a, b in zip(held, cols, strict=True)]
            if at := int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0:
                yield pairs(*(c[:at] for c in held))
                held = [c[at:] for c in held]
        if held is not None and len(held[0]):
            yield pairs(*held)

    near = bounded(cut.repartition("key").sortWithinPartitions("key")).mapInArrow(run, "node long, far int, other long")
    near = near.groupBy("node").agg(F.min(F.struct("far", "other"))["other"].alias("other"))
    return near.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = WORDS, similarity: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, component_id, the smallest non-null id that chains of similar texts reach."""
    docs, member, nodes = named_texts(df, doc_id, text)
    sketch = checkpoint(sketches(docs, words).dropDuplicates(["node"]))
    allowed = F.least("ca", "cb") >= similarity * F.greatest("ca", "cb") - _EPS
    links = checkpoint(_listed(sketch.select("node", "n", F.col("keys").alias("key")), False))
    tried = checkpoint(links.filter(allowed).select("a", "b").distinct())
    found = verified(tried, docs, nodes, words, similarity)
    # Every text under a key that has two or more is an end of a link.
    end = lambda x, n: F.struct(F.col(x).alias("node"), F.col(n).alias("n"))
    ends = checkpoint(links.select("key", F.explode(F.array(end("a", "ca"), end("b", "cb"))).alias("x")).select("key", "x.*").distinct())

    def mixed(ends, root):
        """The ends under keys whose texts are not all in one class."""
        own = checkpoint(ends.join(root.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")))
        keys = own.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
        return checkpoint(own.join(keys.hint("merge"), "key", "left_semi"))

    release(df.sparkSession)
    root = checkpoint(components(found))
    release(df.sparkSession)
    rest = mixed(ends, root)
    for bitwise in (False, *[True] * ROUNDS):
        if rest.isEmpty():
            break
        if bitwise:
            more = apart(rest.join(sketch.select("node", "fp").hint("merge"), "node"), similarity, limit)
        else:
            of = lambda c: rest.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")).distinct().hint("merge")  # noqa: B023, E731
            more = _listed(rest.select("key", "node", "n"), True).filter(allowed).select("a", "b").distinct()
            more = more.join(of("a"), "a").join(of("b"), "b").filter("ra != rb").select("a", "b")
        more = checkpoint(more.distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"))
        tried = tried.unionByName(more)
        found = verified(more, docs, nodes, words, similarity)
        release(df.sparkSession)
        if not found.isEmpty():
            root = extended(root, found)
            rest = mixed(rest.drop("root"), root)
        elif bitwise:
            break
    if not rest.isEmpty():
        sets = sets_of(rest.select("node").distinct(), docs, nodes, words)
        found = checkpoint(across(rest.select("key", "node", "n", "root"), sets, similarity, min(limit, PART)))
        release(df.sparkSession)
        if not found.isEmpty():
            root = extended(root, found)
    # Written out before each join, so that it has plain exchanges on both sides and a hot key can be split.
    named = checkpoint(nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = checkpoint(named.groupBy("root").agg(F.min("first").alias("component_id")))
    named = checkpoint(named.join(least, "root").select("node", "component_id"))
    return member.join(named, "node").select("doc_id", "component_id")
