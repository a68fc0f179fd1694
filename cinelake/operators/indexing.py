"""Distributed ranks over a whole table.

``Window.orderBy`` without a partition key moves every row into one task.
Here the table is range-sorted across all partitions, each row gets its
position inside its partition, and a tiny per-partition count table (one row
per partition, so its size is bounded by the partition count and safe to
broadcast) turns that into a global position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.session import broadcast_if_small, cut_lineage, stored

_LOW_BITS = (1 << 33) - 1
# Groups whose first ranks may be broadcast (about 16 bytes each).
MAX_BROADCAST_GROUPS = 2_000_000


def global_row_number(df: DataFrame, order: list[Column | str], name: str = "rn", start: int = 1) -> DataFrame:
    """row_number() over the whole table ordered by ``order`` (must be a total order)."""
    ranked = stored(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    pid = F.shiftright(F.col("_mid"), 33)
    counts = ranked.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        ranked.join(F.broadcast(offsets), pid == F.col("_pid"))
        .withColumn(name, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) + F.lit(start)).cast("long"))
        .drop("_mid", "_pid", "_off")
    )


def dense_index(df: DataFrame, key: str, name: str, start: int = 0) -> DataFrame:
    """Encode the distinct values of ``key`` to start..start+n-1 in sorted order (LabelEncoder)."""
    return global_row_number(df.select(key).distinct(), [F.col(key)], name, start)


def group_row_number(df: DataFrame, group: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """row_number() within each group, without putting a group into one task.

    ``Window.partitionBy(group)`` sorts a whole group in one task, so a key holding
    a third of all rows would be one task. Instead the rows get a global rank in
    (group, order) order (a range sort spread over all partitions), and each
    group's first rank, a hash aggregate, is subtracted. ``group + order`` must be
    a total order.
    """
    ranked = global_row_number(df, [F.col(c) for c in [*group, *order]], "_g", 0)
    first = stored(ranked.groupBy(*group).agg(F.min("_g").alias("_g0")), "first-ranks")
    return ranked.join(broadcast_if_small(first, MAX_BROADCAST_GROUPS), group).withColumn(name, F.col("_g") - F.col("_g0") + 1).drop("_g", "_g0")


def running_sum(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows up to and with each row, by ``order`` (must be a total order).

    The same plan as ``global_row_number``: running sums inside range
    partitions, shifted by the totals of the partitions before (one row each).
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())).withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    inside = placed.withColumn("_in", F.sum(value).over(Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)))
    totals = placed.groupBy("_pid").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return inside.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_in") + F.col("_off")).drop("_mid", "_pid", "_in", "_off")
