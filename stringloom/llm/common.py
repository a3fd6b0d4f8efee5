"""Plumbing shared by the document operators."""

from __future__ import annotations

import gc
import tempfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast a side only when its counted rows times a stated width stay below this.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch that a worker is given at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves a local session; on a cluster
    that would lose data with its machine, so it is an error there.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage between the steps of a long job.

    Spark deletes the shuffles and checkpoints of a finished step only once the
    driver's collector has found them unused, which a large heap puts off.
    """
    gc.collect()
    spark._jvm.System.gc()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``; a batch is the unit of memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return bounded(df).mapInArrow(run, schema)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches were limited to ``BATCH_BYTES``, unless the user set a limit.

    Workers hold a batch and what they make of it, so this bounds their memory
    whatever the lengths of the texts; a text longer than that is a batch alone.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) in (None, "67108864b"):  # Spark's default
        conf.set(name, str(BATCH_BYTES))
    return df


def as_bytes(text: str) -> Column:
    """UTF-8 bytes of a text column, a null as the empty text."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def maybe_broadcast(df: DataFrame, rows: int, width: int) -> DataFrame:
    """Hint a broadcast for ``rows`` counted rows of ``width`` bytes, else leave a shuffle join."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 marks the held-out rows."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def fold_py(doc_id: int | None) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4


def named_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, mask: int = -1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, member, nodes): texts named by ``node``, a long that no two unlike texts share.

    ``docs`` holds (doc_id, node, __text) of every row and is read again each time
    it is used; ``member`` holds (doc_id, node); ``nodes`` holds, for each text,
    its smallest non-null id ``first``, ``copies``, and whether its first id is
    ``repeats``.  The name is a 64-bit hash (under ``mask``); texts that share one,
    as 124-bit digests tell, are named by another hash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    one = F.xxhash64(body).bitwiseAND(F.lit(mask).cast("long"))
    two = F.conv(F.substring(F.md5(body.cast("binary")), 1, 15), 16, 10).cast("long")
    rows = checkpoint(df.select(F.col(doc_id).alias("doc_id"), one.alias("one"), two.alias("two")))
    # Some forty texts in 10**11 share a name, so the list is short.
    shared = [r["one"] for r in rows.groupBy("one").agg(F.min("two").alias("x"), F.max("two").alias("y")).filter("x != y").collect()]
    name = (lambda a, b: F.when(a.isin(shared), b).otherwise(a)) if shared else (lambda a, b: a)
    member = rows.select("doc_id", name(F.col("one"), F.col("two")).alias("node"))
    ids = member.groupBy("node", "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "n"))
    nodes = ids.groupBy("node").agg(least.alias("f"), F.sum("n").alias("copies"))
    nodes = checkpoint(nodes.select("node", F.col("f.doc_id").alias("first"), (F.col("f.n") > 1).alias("repeats"), "copies"))
    docs = df.select(F.col(doc_id).alias("doc_id"), name(one, two).alias("node"), body.cast("binary").alias("__text"))
    return docs, member, nodes
