"""The churn feature store: one model-ready row per customer, or per user of an event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions.scalars import (
    age_years,
    banded,
    churn_propensity,
    days_between,
    direction,
    money,
    present_flag,
    safe_ratio,
)
from tessera.operators.activity import (
    in_window,
    line_rollup,
    returns_and_breadth,
    rfm_aggregates,
    tier_change,
    trend_columns,
    with_recency,
)
from tessera.operators.sequences import daily, sessions


def order_features(orders: DataFrame, snapshot: str, window_days: int) -> DataFrame:
    """Everything that comes from orders, out of one scan and one row per customer and day.

    Features are of the days before the snapshot, the label is of the window
    after it; no feature sees what the label is made of.
    """
    before = F.col("day") < F.lit(snapshot).cast("date")
    days = daily(
        orders, "o_custkey", F.col("o_orderdate"), F.count("*").alias("n"), F.sum(money(F.col("o_totalprice"))).alias("spend")
    )
    by_day = Window.partitionBy("o_custkey").orderBy("day")
    gap = F.datediff("day", F.lag("day").over(by_day)).cast("long")
    label = (F.count_if(in_window(F.col("day"), snapshot, 0, window_days)) == 0).cast("int")
    known = {c: F.when(before, F.col(c)) for c in ("day", "n", "spend", "gap")}
    sums = days.withColumn("gap", gap).groupBy("o_custkey").agg(
        *rfm_aggregates(known["day"], known["n"], known["spend"], snapshot),
        F.coalesce(F.sum(known["gap"]), F.lit(0)).alias("_gap_sum"),
        F.coalesce(F.sum(known["gap"] * known["gap"]), F.lit(0)).alias("_gap_squares"),
        label.alias("churn_label"),
    )
    n = F.col("total_orders") - 1
    spread = (F.col("_gap_squares") * n - F.col("_gap_sum") * F.col("_gap_sum")) / F.when(n > 1, n * (n - 1))
    return (
        with_recency(sums, snapshot)
        .withColumn("avg_days_between_orders", F.round(F.col("_gap_sum") / F.when(n > 0, n), 4))
        .withColumn("inter_purchase_variance", F.round(F.sqrt(spread), 4))
    )


def churn_features(
    customers: DataFrame,
    orders: DataFrame,
    lines: DataFrame,
    parts: DataFrame,
    snapshot: str,
    window_days: int = fixed.CHURN_WINDOW_DAYS,
    observation_days: int = fixed.OBSERVATION_DAYS,
    base_rate: float = fixed.RETAIL_BASE_RATE,
    with_tier_change: bool = False,
) -> DataFrame:
    """One row per customer: recency, frequency, spend, trends, gaps, returns, breadth, label.

    Features come from what was ordered and shipped before the snapshot, the
    label from the orders in the window after it.
    """
    day = F.lit(snapshot).cast("date")
    from_orders = order_features(orders, snapshot, window_days)
    rollup = line_rollup(lines.where(F.col("l_shipdate") < day), orders.where(F.col("o_orderdate") < day), snapshot)
    from_lines = returns_and_breadth(rollup, parts).withColumnRenamed("o_custkey", "_line_key")
    zero = F.lit(0)
    joined = customers.join(from_orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(
        from_lines, F.col("c_custkey") == F.col("_line_key"), "left"
    )
    propensity = F.round(churn_propensity(F.col("days_since_last_purchase").cast("double"), base_rate), 6)
    trends = trend_columns()
    table = joined.select(
        F.col("c_custkey").alias("customer_id"),
        day.alias("model_snapshot_date"),
        days_between(F.col("first_purchase_date"), day).alias("tenure_days"),
        age_years(F.col("first_purchase_date"), day).alias("tenure_years"),
        F.col("c_mktsegment").alias("acquisition_source"),
        banded(F.col("c_acctbal"), (0, 2500, 5000), ("<0", "0-2500", "2500-5000", ">5000")).alias("balance_band"),
        "days_since_last_purchase",
        *[F.coalesce(f"orders_last_{d}d", zero).cast("long").alias(f"orders_last_{d}d") for d in (30, 90, 365)],
        "avg_days_between_orders",
        "inter_purchase_variance",
        *[F.coalesce(f"spend_last_{d}d", zero).cast("double").alias(f"spend_last_{d}d") for d in (30, 90, 365)],
        F.coalesce("lifetime_spend", zero).cast("double").alias("lifetime_spend"),
        F.coalesce("total_orders", zero).cast("long").alias("total_orders"),
        F.coalesce("average_order_value", F.lit(0.0)).alias("average_order_value"),
        F.coalesce(trends["avg_order_value_last_90d"], F.lit(0.0)).alias("avg_order_value_last_90d"),
        trends["spend_trend_30_vs_90"].alias("spend_trend_30_vs_90"),
        trends["order_freq_trend_90_vs_365"].alias("order_freq_trend_90_vs_365"),
        present_flag(F.col("first_purchase_date")).alias("has_ordered"),
        F.coalesce("returns_last_12m", zero).cast("long").alias("returns_last_12m"),
        "returns_rate",
        F.coalesce("distinct_categories_purchased", zero).cast("long").alias("distinct_categories_purchased"),
        F.coalesce("distinct_brands_purchased", zero).cast("long").alias("distinct_brands_purchased"),
        F.coalesce("churn_label", F.lit(1)).alias("churn_label"),
        propensity.alias("churn_propensity"),
        F.lit(observation_days).alias("observation_window_days"),
        F.lit(window_days).alias("prediction_window_days"),
    )
    if with_tier_change:
        tiers = tier_change(customers, "c_custkey", orders, "o_custkey", "o_orderdate", "o_totalprice", snapshot)
        tiers = tiers.select("c_custkey", F.col("direction").alias("loyalty_tier_change_direction"))
        table = table.join(tiers, F.col("customer_id") == F.col("c_custkey")).drop("c_custkey")
    return table


def activity_features(
    events: DataFrame,
    snapshot: str,
    external: Column,
    key: str = "user_id",
    at: str = "ts",
    kind: str = "event_type",
    amount: str = "value",
    credit_types: Sequence[str] = fixed.CREDIT_TYPES,
    large: float = fixed.LARGE_OUTFLOW,
    windows: Sequence[int] = (7, 14),
    window_days: int = 7,
    base_rate: float = fixed.FINTECH_BASE_RATE,
) -> DataFrame:
    """One row per user: recency, engagement, sessions, failures, flows, label.

    Features are of the days before the snapshot, the label is of the window
    after it. Users who came later have features without a value. Events are combined per user and day, and per user and half hour for the
    sessions, before anything is gathered per user.
    """
    day = F.lit(snapshot).cast("date")
    zero = F.lit(0)
    debit = direction(F.col(kind), credit_types) == "Debit"
    value = money(F.col(amount))
    none = zero.cast("decimal(18,2)")
    outside = F.coalesce(external, F.lit(False))
    before = F.col("day") < day
    days = daily(
        events, key, F.col(at),
        F.count("*").alias("n"),
        F.count_if(F.col(kind) == "error").alias("failed"),
        F.count_if(F.col(kind) == "purchase").alias("bought"),
        F.sum(F.when(debit, -value).otherwise(value)).alias("net"),
        F.sum(F.when(debit, value).otherwise(none)).alias("debit"),
        F.sum(F.when(debit & outside, value).otherwise(none)).alias("external"),
        F.max((debit & outside & (F.col(amount) > large)).cast("int")).alias("large"),
    )
    columns: list[Column] = []
    for n in windows:
        inside = in_window(F.col("day"), snapshot, -n)
        columns += [
            F.sum(F.when(inside, F.col("n")).otherwise(zero)).alias(f"events_last_{n}d"),
            F.count_if(inside).alias(f"days_active_last_{n}d"),
            F.sum(F.when(inside, F.col("failed")).otherwise(zero)).alias(f"failed_last_{n}d"),
            F.sum(F.when(inside, F.col("net")).otherwise(none)).cast("double").alias(f"balance_trend_{n}d"),
        ]
    per_user = days.groupBy(key).agg(
        F.datediff(day, F.min(F.when(before, F.col("day")))).alias("tenure_days"),
        F.datediff(day, F.max(F.when(before, F.col("day")))).alias("days_since_last_activity"),
        F.datediff(day, F.max(F.when(before & (F.col("bought") > 0), F.col("day")))).alias("days_since_last_transaction"),
        *columns,
        F.sum(F.when(before, F.col("debit"))).cast("double").alias("_debit"),
        F.sum(F.when(before, F.col("external"))).cast("double").alias("_external"),
        F.coalesce(F.max(F.when(before, F.col("large"))), zero).alias("large_external_transfer_flag"),
        (F.count_if(in_window(F.col("day"), snapshot, 0, window_days)) == 0).cast("int").alias("churn_label"),
    )
    length = (F.unix_micros("ended") - F.unix_micros("started")) / F.lit(60e6)
    visits = sessions(events.where(F.col(at) < day), key, at).groupBy(F.col(key).alias("_visitor")).agg(
        *[F.count_if(in_window(F.col("started"), snapshot, -n)).alias(f"app_sessions_last_{n}d") for n in windows],
        F.avg(length).alias("avg_session_duration_mins"),
    )
    propensity = churn_propensity(F.col("days_since_last_activity").cast("double"), base_rate)
    return per_user.join(visits, F.col(key) == F.col("_visitor"), "left").select(
        key,
        day.alias("model_snapshot_date"),
        "tenure_days",
        "days_since_last_activity",
        "days_since_last_transaction",
        *[f"{c}{n}d" for n in windows for c in ("events_last_", "days_active_last_", "failed_last_", "balance_trend_")],
        *[F.coalesce(f"app_sessions_last_{n}d", zero).cast("long").alias(f"app_sessions_last_{n}d") for n in windows],
        "avg_session_duration_mins",
        safe_ratio(F.col("_external"), F.col("_debit"), 4).alias("external_transfer_ratio"),
        "large_external_transfer_flag",
        "churn_label",
        F.round(propensity, 6).alias("churn_propensity"),
        F.lit(max(windows)).alias("observation_window_days"),
        F.lit(window_days).alias("prediction_window_days"),
    )
