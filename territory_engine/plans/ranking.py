"""Row numbers within groups that may be very large (skew-safe ``row_number``).

``row_number() over (partition by k order by o)`` sorts each group in one task. Here the rows
are range-partitioned on (k, o) instead, so a large group is spread over many partitions in
order; each row is numbered inside its (partition, group) and shifted by the number of rows
of its group in earlier partitions. The partition ids are pinned by a reliable checkpoint
(the checkpoint folder of the session), so the numbering and the offsets come from the same
materialised partitioning even if a task is re-run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def row_number_spread(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank",
                      partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out`` = 1-based position within ``keys`` by ``order`` (ties broken by ``order``).

    ``order`` should make rows unique within a group for a deterministic result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    tagged = ranged.withColumn("_pid", F.spark_partition_id()).checkpoint()
    local = tagged.withColumn("_ln", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order)))
    counts = tagged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, ["_pid", *keys]).withColumn(out, (F.col("_ln") + F.col("_off")).cast("long")).drop(
        "_pid", "_ln", "_off")


def position_spread(df: DataFrame, column: str, out: str = "position") -> DataFrame:
    """``df`` plus ``out`` = 1-based position of each row in the whole table, largest ``column`` first
    (rows with equal values share the first position of their run; a null has none).

    Values are counted map-side, range-partitioned, summed inside their partitions and shifted by the
    counts of earlier partitions, so no task sees the whole table.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    tagged = counts.repartitionByRange(n, F.desc(column)).withColumn("_pid", F.spark_partition_id()).checkpoint()
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    shift = tagged.groupBy("_pid").agg(F.sum("_n").alias("_t")).select("_pid", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))
    above = Window.partitionBy("_pid").orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)
    placed = tagged.withColumn("_in", F.coalesce(F.sum("_n").over(above), F.lit(0))).join(shift, "_pid").select(
        column, (F.col("_in") + F.col("_off") + 1).cast("long").alias(out))
    return df.join(placed, column, "left")
