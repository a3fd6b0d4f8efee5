"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted.  A text longer than the largest is cut:
its full pieces each fill a sequence of their own, the rest is an item.  Items
are dealt to shards of bounded size and packed per shard, longest first:

* an item goes to the open bin, of any capacity, that it fills best;
* if none has room, a bin is opened in the size of least cost for a token: a
  sequence of ``c`` tokens costs ``overhead + c + c * c / quadratic`` (attention
  grows with the square), divided by what the item and the shorter items still
  waiting could fill of it;
* when all items are placed, each bin shrinks to the smallest permitted capacity
  that holds its contents.

Lengths are tokens of a byte-level BPE vocabulary where its rank file is given,
or the numbers in a length column, else words (runs of characters other than
ASCII white space).

Defined results: a null or empty text has no tokens and gets one row without a
bin, as has a blank one where lengths are words.  A text longer than the largest
capacity is cut.  Of equal lengths the row that is read first is placed first, so
bins, but not their contents' sum, depend on how the table lies in files.  Rows
that repeat an id are packed each; an empty table gives no rows; other input
columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.byte_bpe import count_frame
from stringloom.llm.common import as_bytes, checkpoint, map_batches

CAPACITIES = (256, 512, 1024, 2048)
#: Items of a shard.
SHARD = 4096
OVERHEAD, QUADRATIC = 16, 65536


class Stock:
    """Items that wait, as counts by length, for estimates of what could fill a gap."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for n in sizes:
            self.count[n] = self.count.get(n, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.count[n]
            del self.sizes[bisect_left(self.sizes, n)]

    def fill(self, gap: int) -> int:
        """Tokens of ``gap`` that waiting items can fill, longest first."""
        room, at = gap, len(self.sizes)
        while room and (at := bisect_right(self.sizes, room, 0, at)):
            at -= 1
            n = self.sizes[at]
            room -= n * min(self.count[n], room // n)
        return gap - room


def pack(sizes: list[int], capacities=CAPACITIES, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) for each item; sizes are 1 ... max(capacities)."""
    caps = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    stock = Stock(sizes)
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    used: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in order:
        n = sizes[i]
        stock.take(n)
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b = len(used)
            used.append(0)
            fits = caps[bisect_left(caps, n) :]
            room = min(fits, key=lambda c: ((overhead + c + c * c / quadratic) / (n + stock.fill(c - n)), c))
        placed[i] = (b, used[b])
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    final = [caps[bisect_left(caps, u)] for u in used]
    return [(b, at, final[b]) for b, at in placed]


def lengths(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) with words as tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(x.as_py().split()) for x in batch.column("__text")]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64())})

    kind = df.schema[doc_id].dataType.simpleString()
    return map_batches(df.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("__text")), run, f"doc_id {kind}, n_tokens long")


def best_fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: str | None = None, ranks: str | None = None, pattern: str | None = None, capacities=CAPACITIES, shard: int = SHARD, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> DataFrame:
    """One row per piece of each input row: doc_id, piece, piece_start, n_tokens, bin_id, bin_offset, bin_capacity.

    ``ranks`` is the path of a rank file and ``pattern`` what its vocabulary splits texts by.
    ``piece_start`` and ``n_tokens`` are in tokens of the text, ``bin_offset`` in tokens of the bin.
    """
    top = max(capacities)
    if length:
        rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n_tokens"))
    else:
        rows = count_frame(df, ranks, pattern, doc_id, text) if ranks else lengths(df, doc_id, text)
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    full = rows.filter(F.col("n_tokens") >= top).select(
        "row", "doc_id", F.explode(F.expr(f"sequence(0, cast(n_tokens div {top} as int) - 1)")).alias("piece")
    ).select(
        "doc_id", "piece", (F.col("piece").cast("long") * top).alias("piece_start"), F.lit(top).cast("long").alias("n_tokens"),
        F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"), F.lit(top).cast("long").alias("bin_capacity"),
    )
    blank = rows.filter("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), *(F.lit(0).cast("long").alias(c) for c in ("piece_start", "n_tokens")), F.lit(None).cast("string").alias("bin_id"), *(F.lit(None).cast("long").alias(c) for c in ("bin_offset", "bin_capacity")))
    rest = rows.select("row", "doc_id", F.expr(f"cast(n_tokens div {top} as int)").alias("piece"), (F.col("n_tokens") % top).alias("n_tokens")).filter("n_tokens > 0")
    shards = max(1, -(-rest.count() // shard))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def run(part):
        part = part.sort_by("row")
        sizes = part.column("n_tokens").to_pylist()
        b, at, cap = zip(*pack(sizes, capacities, overhead, quadratic), strict=True)
        piece = part.column("piece").to_pylist()
        key = part.column("shard")[0].as_py()
        return pa.table({
            "doc_id": part.column("doc_id"), "piece": part.column("piece"), "piece_start": pa.array([p * top for p in piece], pa.int64()), "n_tokens": part.column("n_tokens"),
            "bin_id": pa.array([f"{key}-{x}" for x in b]), "bin_offset": pa.array(at, pa.int64()), "bin_capacity": pa.array(cap, pa.int64()),
        })

    kind = rows.schema["doc_id"].dataType.simpleString()
    packed = rest.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece int, piece_start long, n_tokens long, bin_id string, bin_offset long, bin_capacity long")
    return packed.unionByName(full).unionByName(blank)
