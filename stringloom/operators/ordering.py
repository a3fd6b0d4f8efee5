"""Positions in key order without one task that sees every row.

Rows are dealt by ranges of the key; each partition counts and sums its own, and
the totals of the partitions before it are added.  Only one number a partition
passes through the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringloom.operators.shared import checkpoint


def running(df: DataFrame, key: str, amount: str | None, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` (of one, if None) over all rows with a smaller key.

    Keys are distinct.  Null amounts count as nothing.
    """
    spark = df.sparkSession
    n = F.lit(1).cast("long") if amount is None else F.coalesce(F.col(amount), F.lit(0)).cast("long")
    dealt = df.withColumn("__n", n).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    dealt = checkpoint(dealt.withColumn("__part", F.spark_partition_id()))  # ranges are sampled; both uses must see the same
    totals = sorted(dealt.groupBy("__part").agg(F.sum("__n").alias("n")).collect())
    starts = [0, *accumulate(r["n"] for r in totals)][: len(totals)]
    base = spark.createDataFrame([(r["__part"], s) for r, s in zip(totals, starts, strict=True)], "__part int, __start bigint")
    before = F.sum("__n").over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("__before", before).join(F.broadcast(base), "__part")  # one row a partition
    return out.withColumn(name, F.col("__start") + F.coalesce("__before", F.lit(0))).drop("__n", "__part", "__before", "__start")


def row_ids(df: DataFrame, key: str, name: str = "row_id") -> DataFrame:
    """``df`` with 0-based positions in the order of its distinct keys."""
    return running(df, key, None, name)
