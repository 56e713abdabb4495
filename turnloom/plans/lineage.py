"""Cutting lineage with files that every executor can read."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Where that is unset, one temporary folder a context in local mode; on a cluster it must be set."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(context, "_turnloom_folder"):
        context._turnloom_folder = tempfile.mkdtemp(prefix="turnloom-")
    return context._turnloom_folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df``: survives the loss of an executor and ends its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


def width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` rows at ``per_task`` a task, never under the session's shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row among those of its ``by``, from 1, whatever a key's share of all rows.

    Rows are sorted in ranges over key and order together; the ranges' row counts, one per key and range, give
    each range its first place.  ``order`` must tell all rows of a key apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in by]
    sorted_ = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    local = cut(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    size = local.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = size.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_part").alias("_p"), "_first", before.alias("_before"))
    same = (F.col("_part") == F.col("_p"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    place = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("bigint")
    return local.join(starts, same).withColumn(name, place).select(*df.columns, name)
