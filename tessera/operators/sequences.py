"""Order-dependent measures per key: gaps, first events, running and rolling sums, sessions.

One key may own a large part of all rows, so no window here runs over all rows
of a key. Rows are first combined per key and calendar slot (day, half hour),
which happens before the shuffle; windows then see at most one row per slot of
the calendar, and the result is brought back to the rows where it belongs.
Running totals, which differ from row to row, are cut by task instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.session import shared_folder


def daily(df: DataFrame, key: str, day: Column, *aggregates: Column) -> DataFrame:
    """key, day and aggregates: one row per key and active day."""
    return df.groupBy(F.col(key), day.cast("date").alias("day")).agg(*aggregates)


def _by_day(key: str) -> Window:
    return Window.partitionBy(key).orderBy("day")


def days_since_previous(df: DataFrame, key: str, row_id: str, at: str) -> DataFrame:
    """row_id, key, days since the key's previous row (NULL for its first), ordered by at and row_id.

    Only the first row of a day looks back to an earlier day; all others follow
    a row of the same day.
    """
    days = daily(df, key, F.col(at), F.min_by(row_id, F.struct(at, row_id)).alias("_first"))
    first = days.select(
        F.col("_first"),
        F.datediff("day", F.lag("day").over(_by_day(key))).alias("_gap"),
    )
    # the row id is unique, so this join has no hot key
    joined = df.select(row_id, key).join(first, F.col(row_id) == F.col("_first"), "left")
    return joined.select(row_id, key, F.when(F.col("_first").isNotNull(), F.col("_gap")).otherwise(F.lit(0)).alias("days_since_previous"))


def first_flags(df: DataFrame, key: str, row_id: str, at: str) -> DataFrame:
    """row_id, key, is_first: the earliest row of every key, by at and row_id."""
    first = df.groupBy(key).agg(F.min_by(row_id, F.struct(at, row_id)).alias("_first")).select("_first")
    joined = df.select(row_id, key).join(first, F.col(row_id) == F.col("_first"), "left")
    return joined.select(row_id, key, F.col("_first").isNotNull().alias("is_first"))


def gap_statistics(df: DataFrame, key: str, at: str) -> DataFrame:
    """key, gaps, avg_gap_days, gap_std_days: days between consecutive rows of a key.

    Rows of one day are zero days apart, so sums over active days are enough,
    and they are exact whole numbers.
    """
    days = daily(df, key, F.col(at), F.count("*").alias("n"))
    gap = F.datediff("day", F.lag("day").over(_by_day(key))).cast("long")
    sums = (
        days.withColumn("gap", gap)
        .groupBy(key)
        .agg(
            (F.sum("n") - 1).alias("gaps"),
            F.coalesce(F.sum("gap"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).alias("squares"),
        )
    )
    n, total, squares = F.col("gaps"), F.col("total"), F.col("squares")
    spread = F.sqrt((squares * n - total * total) / F.when(n > 1, n * (n - 1)))
    return sums.select(
        key, "gaps", (total / F.when(n > 0, n)).alias("avg_gap_days"), spread.alias("gap_std_days")
    )


def running_total(
    df: DataFrame, key: str, order: Sequence[str], amount: Column, keep: Sequence[str]
) -> DataFrame:
    """keep..., running_total: sum of amount over the key's rows up to this one.

    The order must be unique within a key, and amounts should be decimals, so
    that parts add up exactly. Rows are range-sorted by key and order, which
    spreads the rows of a hot key over many tasks. Each task's share of a key is
    summed up on its own, and what the key had in the tasks before is added. The
    sorted rows are written once, so that both steps see the same tasks.
    """
    shared_folder(df.sparkSession)
    rows = (
        df.select(*dict.fromkeys([*keep, key, *order]), amount.alias("_amount"))
        .orderBy(key, *order)
        .withColumn("_task", F.spark_partition_id())
        .checkpoint()
    )
    shares = rows.groupBy(key, "_task").agg(F.sum("_amount").alias("_share"))
    # one row per key and task; only keys spread over several tasks have anything before
    earlier = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = shares.select(key, "_task", F.sum("_share").over(earlier).alias("_amount")).where(F.col("_amount").isNotNull())
    # what came before enters as one more row ahead of the others, which spares a join
    both = rows.withColumn("_row", F.lit(True)).unionByName(before.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    up_to_here = (
        Window.partitionBy("_task", key).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = both.withColumn("running_total", F.sum("_amount").over(up_to_here)).where("_row")
    return totals.select(*keep, "running_total")


def rolling_sum(df: DataFrame, key: str, at: str, amount: Column, days: int) -> DataFrame:
    """key, day, rolling_sum: amount over the last `days` days up to and including each active day."""
    totals = daily(df, key, F.col(at), F.sum(amount).alias("_sum"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    window = Window.partitionBy(key).orderBy(number).rangeBetween(-(days - 1), 0)
    return totals.select(key, "day", F.sum("_sum").over(window).alias("rolling_sum"))


def sessions(df: DataFrame, key: str, at: str, gap_minutes: int = fixed.SESSION_GAP_MINUTES) -> DataFrame:
    """key, session (1, 2, ...), started, ended, events; a pause longer than the gap ends a session.

    Within a slot as long as the gap no pause can exceed it, so the first and
    last moment of every slot decide.
    """
    gap = gap_minutes * 60 * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    # whole-number division towards minus infinity, also before 1970
    slot = ((F.col("_at") - F.pmod(F.col("_at"), F.lit(gap))) / gap).cast("long")
    slots = (
        df.select(key, micros.alias("_at"))
        .groupBy(key, slot.alias("_slot"))
        .agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count("*").alias("_events"))
    )
    by_slot = Window.partitionBy(key).orderBy("_slot")
    previous = F.lag("_to").over(by_slot)
    opens = (previous.isNull() | (F.col("_from") - previous > gap)).cast("int")
    numbered = slots.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(by_slot))
    return numbered.groupBy(key, "session").agg(
        F.timestamp_micros(F.min("_from")).alias("started"),
        F.timestamp_micros(F.max("_to")).alias("ended"),
        F.sum("_events").alias("events"),
    )
