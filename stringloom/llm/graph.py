"""Connected components by contracting local forests, all in DataFrames.

In each round the edges lie in blocks of bounded size.  A block becomes a forest:
every node points to the node with the smallest hash that it reaches inside the
block.  If all blocks name one root for each node, these are the components.
Otherwise every node moves to the smallest of its roots, the forests are rewritten
between the nodes that remain, and the next round works on them.  Two rounds share a
hash: the first moves a hub to its smallest neighbour, the second then moves all
of its other neighbours there.  After that the hash changes, so that a constant
share of the nodes goes each time, whatever the shape of the graph.  The maps of
all rounds are then applied in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import bounded, checkpoint, release

#: Edges of a block; a task holds two blocks at most.
BLOCK = 1 << 20


def _hash(x: np.ndarray, k: int) -> np.ndarray:
    """64-bit mix of nodes, another one for each ``k``; signed, as Spark compares it."""
    x = x.view(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def forest(a: np.ndarray, b: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes of the edges (a, b): the root is the reachable node with the smallest hash."""
    nodes = np.unique(np.r_[a, b])
    rank = np.argsort(_hash(nodes, k), kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[rank] = np.arange(len(nodes))
    a, b = (place[np.searchsorted(nodes, x)] for x in (a, b))
    up = np.arange(len(nodes))
    while len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(up, hi, lo)
        while (up != (over := up[up])).any():
            up = over
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[rank[up[place]]]


def _forests(edges: DataFrame, k: int, block: int) -> DataFrame:
    """(node, root, h) of the forests of ``edges`` (a, b), ``h`` being the root's hash; roots point to themselves."""

    def out(node, root):
        return pa.RecordBatch.from_pydict({"node": pa.array(node), "root": pa.array(root), "h": pa.array(_hash(root, k))})

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            parts.append(tuple(batch.column(c).to_numpy() for c in "ab"))
            size += batch.num_rows
            if size >= block:
                node, root = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
                # A forest that has become small goes on with the next edges.
                if 2 * len(node) >= block:
                    yield out(node, root)
                    parts, size = [], 0
                else:
                    parts, size = [(node, root)], len(node)
        if size:
            yield out(*forest(*(np.concatenate(x) for x in zip(*parts, strict=True)), k))

    return bounded(edges).mapInArrow(run, "node long, root long, h long")


def components(edges: DataFrame, src: str = "a", dst: str = "b", *, block: int = BLOCK) -> DataFrame:
    """(node, root) for every node that has an edge to another node.

    ``edges`` holds two columns of longs; direction, repeats and loops do not
    matter.  Rows with a null end are ignored.  ``root`` is one node of the
    component.  A hub is harmless: blocks combine its edges before the shuffle,
    and the joins are plain equi-joins that adaptive execution splits.  They are merge
    joins at any size, as the many small tables of the rounds would otherwise pass
    through the driver as broadcasts.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a != b")
    steps = []
    while True:
        k = len(steps) // 2
        # Forests of the partitions as they lie, so that only these are counted and moved into blocks.
        own = checkpoint(_forests(e, k, block))
        blocks = -(-own.count() // block)
        if blocks > 1:
            own = own.repartition(blocks, "root")
        elif blocks:
            own = own.coalesce(1)
        own = _forests(own.select(F.col("node").alias("a"), F.col("root").alias("b")), k, block)
        if blocks > 1:
            own = checkpoint(own)
        ends = F.struct("h", "root")
        step = checkpoint(own.groupBy("node").agg(F.min(ends)["root"].alias("to"), F.max(ends)["root"].alias("other")))
        steps.append(step.select("node", "to"))
        if blocks < 2 or step.filter("to != other").isEmpty():
            break
        e = own.join(steps[-1].hint("merge"), "node").select("to", "root").distinct()
        e = e.join(steps[-1].select(F.col("node").alias("root"), F.col("to").alias("b")).hint("merge"), "root")
        e = checkpoint(e.select(F.col("to").alias("a"), "b").filter("a != b").distinct())
        if len(steps) % 2 == 0:
            release(e.sparkSession)
    out = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def extended(root: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further ``links`` (a, b); only the classes that they join are worked on."""
    named = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")).hint("merge")
    ends = checkpoint(links.select("a", "b").filter("a is not null and b is not null").join(named("a"), "a", "left").join(named("b"), "b", "left"))
    over = components(ends.select(*(F.coalesce(f"r{c}", c).alias(c) for c in "ab")))
    over = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
    fresh = ends.select(F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.col(f"r{c}").alias("r")) for c in "ab"))).alias("x"))
    fresh = fresh.select("x.*").filter("r is null").select("node").distinct()
    every = root.select("node", "root").unionByName(fresh.select("node", F.col("node").alias("root")))
    return checkpoint(every.join(over.hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
