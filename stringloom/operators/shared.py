"""What the columns ask of a session: folders that driver and executors share, small batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that a worker is given at a time.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder in a local session, an error on a cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches were limited to ``BATCH_BYTES``, unless the user set a limit.

    Spark's own limit lets batches grow with the table up to 10,000 rows or 64 MiB,
    and a worker holds several forms of a batch at a time.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) in (None, "67108864b"):  # Spark's default
        conf.set(name, str(BATCH_BYTES))
    return df
