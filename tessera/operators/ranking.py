"""Ranks and quantile groups over a whole table, without one task seeing it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shared_folder


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """Adds rank (1 for the first row) and total (rows) in a total order given by the expressions.

    The rows are range-sorted; each task numbers its own rows, and the counts
    of the tasks before it are added. The sorted rows are written once, so that
    both steps see the same tasks.
    """
    shared_folder(df.sparkSession)
    local = F.monotonically_increasing_id()
    rows = (
        df.orderBy(*order)
        .select("*", local.alias("_id"))
        .select("*", F.shiftright("_id", 33).alias("_task"))
        .checkpoint()
    )
    # one row per task of the sort
    counts = rows.groupBy("_task").agg(F.count("*").alias("_rows"), F.min("_id").alias("_start"))
    tasks = Window.orderBy("_task")
    earlier = tasks.rowsBetween(Window.unboundedPreceding, -1)
    everything = tasks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(
        "_task",
        "_start",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(everything).alias("total"),
    )
    # at most one row of four numbers per shuffle partition, so it can be broadcast
    return (
        rows.join(F.broadcast(starts), "_task")
        .withColumn("rank", F.col("_before") + F.col("_id") - F.col("_start") + 1)
        .drop("_task", "_id", "_start", "_before")
    )


def ntile_of(rank: Column, total: Column, groups: int) -> Column:
    """Group number of a rank when `total` rows are cut into groups, the larger groups first."""
    small = F.floor(total / groups)
    larger = total % groups
    cut = larger * (small + 1)
    return (
        F.when(rank <= cut, F.floor((rank - 1) / (small + 1)))
        .otherwise(larger + F.floor((rank - 1 - cut) / F.when(small > 0, small)))
        .cast("int")
        + 1
    )


def ntile(df: DataFrame, groups: int, *order: Column) -> DataFrame:
    """Adds tile (1 to groups) in a total order over the whole table."""
    ranked = global_rank(df, *order)
    tile = ntile_of(F.col("rank"), F.col("total"), groups)
    return ranked.withColumn("tile", tile).drop("rank", "total")
