"""Iterative plans: each step's table is checkpointed, so that lineage stays short and survives lost executors."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a fresh local one will do for a local
    master; on a cluster each executor would write to its own disk, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, checkpointed with its rows dealt by the keys into as many partitions as shuffles make, so that joins on these keys need
    not move it again."""
    return cut(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys))


def grow(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], most: int | None) -> DataFrame:
    """Union of start and what step makes of the newest rows, again and again, until nothing new comes or `most` steps are done."""
    parts, newest, k = [start], start, 0
    while most is None or k < most:
        k += 1
        newest = cut(step(newest, k))
        if newest.isEmpty():
            break
        parts.append(newest)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def running(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with the column `name`: the sum of `value` (longs) over all rows before, in the order of a column without ties.

    Rows are dealt by ranges of that column and checkpointed; sums within a range join those of the ranges before it, a row each, so
    that no task orders all rows."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut(rows.repartitionByRange(parts, order)).withColumn("_part", F.spark_partition_id())
    sums = d.groupBy("_part").agg(F.sum(value).alias("_sum"))
    base = sums.select("_part", F.coalesce(F.sum("_sum").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(value).over(before(Window.partitionBy("_part").orderBy(order))), F.lit(0))
    return d.withColumn("_own", own).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_own", "_base")


#: Rows of sums that the driver adds itself.
FLAT = 16


def summed(sums: DataFrame, tasks: int) -> np.ndarray | None:
    """The elementwise sum of the column `sums` (binary, doubles) over all rows, one a task at most: tasks' rows are added by groups
    of about the square root of their number first, so that the driver holds as many. None without rows."""

    def run(batches):
        total = None
        for b in batches:
            for v in b.column("sums"):
                x = np.frombuffer(v.as_py(), np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    if tasks > FLAT:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(run, "sums binary")
    rows = [np.frombuffer(r.sums, np.float64) for r in sums.collect()]
    return np.sum(rows, axis=0) if rows else None
