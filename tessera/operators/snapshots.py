"""Features and label of many snapshot dates from one scan of the activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions.scalars import money
from tessera.functions.sqltext import name_sql


def snapshot_features(
    customers: DataFrame,
    customer_key: str,
    activity: DataFrame,
    key: str,
    date: str,
    amount: str,
    snapshots: Sequence[str],
    days: Sequence[int] = (30, 90, 365),
    label_days: int = fixed.CHURN_WINDOW_DAYS,
) -> DataFrame:
    """One row per customer and snapshot: counts and spend of the days before it, in all and by window, recency, churn label.

    Activity is added up by key and day first, which a hot key shrinks to its
    days before any shuffle. A day then counts for the snapshots that it lies
    before, and for the label of the one it follows; sums by key and snapshot are
    combined in the tasks again. The activity is read once, however many
    snapshots there are. Features look back only; churned is who has no activity in
    the `label_days` from the snapshot on. Dates that come twice count once.
    """
    if not snapshots:
        raise ValueError("no snapshots given")
    given = F.array(*[F.lit(day).cast("date") for day in sorted(set(snapshots))])
    own = activity.select(F.col(name_sql(key)).alias("_key"), F.col(name_sql(date)).cast("date").alias("_day"), money(F.col(name_sql(amount))).alias("_amount"))
    daily = own.where(F.col("_key").isNotNull() & F.col("_day").isNotNull()).groupBy("_key", "_day")
    daily = daily.agg(F.count("*").alias("_n"), F.sum("_amount").alias("_spend"))
    ahead = F.filter(given, lambda s: s > F.date_sub(F.col("_day"), label_days))
    each = daily.withColumn("snapshot", F.explode(ahead)).withColumn("_ago", F.datediff("snapshot", "_day"))
    before = F.col("_ago") > 0
    sums = [F.sum(F.when(before, F.col("_n"))).alias("total_orders"), F.sum(F.when(before, F.col("_spend"))).alias("lifetime_spend")]
    for d in days:
        inside = before & (F.col("_ago") <= d)
        sums += [F.sum(F.when(inside, F.col("_n"))).alias(f"orders_last_{d}d"), F.sum(F.when(inside, F.col("_spend"))).alias(f"spend_last_{d}d")]
    sums += [F.min(F.when(before, F.col("_ago"))).alias("days_since_last_purchase"), F.count_if(~before).alias("_later")]
    found = each.groupBy("_key", "snapshot").agg(*sums)
    wanted = customers.select(F.col(name_sql(customer_key)).alias("customer_id"), F.explode(given).alias("snapshot"))
    met = wanted.join(found.withColumnRenamed("snapshot", "_snapshot"), (F.col("customer_id") == F.col("_key")) & (F.col("snapshot") == F.col("_snapshot")), "left")
    counts = ["total_orders", *(f"orders_last_{d}d" for d in days)]
    spends = ["lifetime_spend", *(f"spend_last_{d}d" for d in days)]
    return met.select(
        "customer_id",
        "snapshot",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in spends],
        "days_since_last_purchase",
        (F.coalesce("_later", F.lit(0)) == 0).cast("int").alias("churn_label"),
    )
