"""Per-customer, per-product and per-account measures from orders, lines and events."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions.scalars import direction, money, safe_ratio
from tessera.operators.ranking import global_rank, ntile_of


def in_window(at: Column, snapshot: str, start: int, end: int = 0) -> Column:
    """True for days from snapshot + start (included) to snapshot + end (not included)."""
    base = F.lit(snapshot).cast("date")
    day = at.cast("date")
    return (day >= F.date_add(base, start)) & (day < F.date_add(base, end))


def rfm_aggregates(
    at: Column, orders: Column, amount: Column, snapshot: str, windows: Sequence[int] = (30, 90, 365)
) -> list[Column]:
    """Recency, frequency and spend per key, over single orders or over daily sums of them."""
    zero = F.lit(0).cast("decimal(18,2)")
    result = [
        F.max(at.cast("date")).alias("last_purchase_date"),
        F.min(at.cast("date")).alias("first_purchase_date"),
        F.sum(orders).alias("total_orders"),
        F.sum(amount).alias("lifetime_spend"),
    ]
    for days in windows:
        inside = in_window(at, snapshot, -days)
        result.append(F.sum(F.when(inside, orders).otherwise(F.lit(0))).cast("long").alias(f"orders_last_{days}d"))
    for days in windows:
        inside = in_window(at, snapshot, -days)
        result.append(F.sum(F.when(inside, amount).otherwise(zero)).alias(f"spend_last_{days}d"))
    return result


def rfm_features(orders: DataFrame, key: str, at: str, amount: str, snapshot: str) -> DataFrame:
    """One row per key with orders; a last purchase after the snapshot gives negative days."""
    return with_recency(
        orders.groupBy(key).agg(*rfm_aggregates(F.col(at), F.lit(1), money(F.col(amount)), snapshot)), snapshot
    )


def with_recency(rfm: DataFrame, snapshot: str) -> DataFrame:
    base = F.lit(snapshot).cast("date")
    return rfm.withColumn("days_since_last_purchase", F.datediff(base, "last_purchase_date")).withColumn(
        "average_order_value", F.round(F.col("lifetime_spend") / F.col("total_orders"), 2).cast("double")
    )


def trend_columns() -> dict[str, Column]:
    """Ratios of the windows of rfm_features; NULL or 0 where the base is empty."""
    spend30, spend90 = F.col("spend_last_30d").cast("double"), F.col("spend_last_90d").cast("double")
    return {
        "avg_order_value_last_90d": safe_ratio(F.col("spend_last_90d"), F.col("orders_last_90d"), 2, 0.0),
        "spend_trend_30_vs_90": safe_ratio(spend30, spend90 / 3, 3),
        "order_freq_trend_90_vs_365": safe_ratio(F.col("orders_last_90d"), F.col("orders_last_365d") / 4, 3),
    }


def churn_labels(
    customers: DataFrame, key: str, orders: DataFrame, order_key: str, at: str, snapshot: str,
    window_days: int = fixed.CHURN_WINDOW_DAYS,
) -> DataFrame:
    """key, churn_label: 1 without any order in the window after the snapshot."""
    active = orders.where(in_window(F.col(at), snapshot, 0, window_days)).select(F.col(order_key).alias("_active")).distinct()
    joined = customers.select(key).join(active, F.col(key) == F.col("_active"), "left")
    return joined.select(key, F.col("_active").isNull().cast("int").alias("churn_label"))


def churn_rate(labelled: DataFrame, label: str = "churn_label") -> DataFrame:
    return labelled.agg(
        F.count("*").alias("customers"),
        F.sum(label).alias("churned"),
        F.round(F.avg(label) * 100, 1).alias("churn_rate"),
    )


@dataclass(frozen=True)
class LineColumns:
    """Names of the columns of order lines, orders and parts; by default those of the given tables."""

    line_order: str = "l_orderkey"
    line_part: str = "l_partkey"
    flag: str = "l_returnflag"
    shipped: str = "l_shipdate"
    order: str = "o_orderkey"
    customer: str = "o_custkey"
    part: str = "p_partkey"
    category: str = "p_type"
    brand: str = "p_brand"
    returned: str = "R"


GIVEN = LineColumns()


def bought_lines(lines: DataFrame, orders: DataFrame, names: LineColumns = GIVEN) -> DataFrame:
    """Lines with the customer of their order.

    Order keys are unique among the orders, so an order with very many lines is
    a skewed side that adaptive execution can split.
    """
    buyers = orders.select(names.order, names.customer)
    return lines.join(buyers, F.col(names.line_order) == F.col(names.order))


#: Lines of a task that groups them by customer and part: nearly all pairs differ, and its hash tables take some 200 MB.
TASK_LINES = 500_000


def dealt_lines(lines: DataFrame, orders: DataFrame, names: LineColumns = GIVEN, keep: Sequence[str] = ()) -> DataFrame:
    """Customer, part and the kept columns of bought lines, dealt by customer and part to tasks of a bounded size.

    Customers seldom buy a part twice, so combining lines before the shuffle would only
    fill tables with them; and merged to fewer tasks, as adaptive execution does, a
    task's table would grow with the input.
    """
    bought = bought_lines(lines, orders, names).select(names.customer, names.line_part, *keep)
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, math.ceil(lines.count() / TASK_LINES))
    return bought.repartition(tasks, names.customer, names.line_part)


def line_rollup(lines: DataFrame, orders: DataFrame, snapshot: str, names: LineColumns = GIVEN) -> DataFrame:
    """One row per customer and part: lines, returned lines, returned in the last 12 months."""
    returned = F.col(names.flag) == names.returned
    return (
        dealt_lines(lines, orders, names, [names.flag, names.shipped])
        .groupBy(names.customer, names.line_part)
        .agg(
            F.count("*").alias("lines"),
            F.count_if(returned).alias("returned"),
            F.count_if(returned & in_window(F.col(names.shipped), snapshot, -365)).alias("returned_12m"),
        )
    )


def returns_and_breadth(rollup: DataFrame, parts: DataFrame, names: LineColumns = GIVEN) -> DataFrame:
    """Per customer: lines, returns, returns rate, distinct categories and brands."""
    kinds = parts.select(names.part, names.category, names.brand)
    return (
        rollup.join(kinds, F.col(names.line_part) == F.col(names.part), "left")
        .groupBy(names.customer)
        .agg(
            F.sum("lines").alias("lines"),
            F.sum("returned_12m").alias("returns_last_12m"),
            F.round(F.sum("returned") / F.sum("lines"), 4).alias("returns_rate"),
            F.count_distinct(names.category).alias("distinct_categories_purchased"),
            F.count_distinct(names.brand).alias("distinct_brands_purchased"),
        )
    )


def product_breadth(lines: DataFrame, orders: DataFrame, parts: DataFrame, names: LineColumns = GIVEN) -> DataFrame:
    """Distinct categories and brands per customer."""
    bought = (
        dealt_lines(lines, orders, names)
        .distinct()
        .join(parts.select(names.part, names.category, names.brand), F.col(names.line_part) == F.col(names.part))
    )
    return bought.groupBy(names.customer).agg(
        F.count_distinct(names.category).alias("distinct_categories"), F.count_distinct(names.brand).alias("distinct_brands")
    )


def returns_rate(lines: DataFrame, orders: DataFrame, snapshot: str, names: LineColumns = GIVEN) -> DataFrame:
    """Returned lines in the last 12 months and share of all lines, per customer."""
    returned = F.col(names.flag) == names.returned
    per_order = lines.groupBy(names.line_order).agg(
        F.count("*").alias("lines"),
        F.count_if(returned).alias("returned"),
        F.count_if(returned & in_window(F.col(names.shipped), snapshot, -365)).alias("returned_12m"),
    )
    return (
        per_order.join(orders.select(names.order, names.customer), F.col(names.line_order) == F.col(names.order))
        .groupBy(names.customer)
        .agg(
            F.sum("returned_12m").alias("returns_last_12m"),
            F.round(F.sum("returned") / F.sum("lines"), 4).alias("returns_rate"),
        )
    )


def product_signals(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Per part: buyers, share of buyers who returned it, share who ordered it again."""
    per_buyer = (
        bought_lines(lines, orders)
        .groupBy("l_partkey", "o_custkey")
        .agg(
            # two different orders are enough, so no distinct count is needed
            (F.min("l_orderkey") != F.max("l_orderkey")).cast("int").alias("again"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"),
        )
    )
    return per_buyer.groupBy("l_partkey").agg(
        F.count("*").alias("buyers"),
        F.round(F.avg("returned"), 4).alias("return_rate"),
        F.round(F.avg("again"), 4).alias("repeat_purchase_rate"),
    )


def customer_360(
    customers: DataFrame, nations: DataFrame, orders: DataFrame, lines: DataFrame, parts: DataFrame
) -> DataFrame:
    """One row per customer with nation, order, line and list-price totals.

    Lines are combined per order before they meet the orders. Spark broadcasts
    the dimension tables while they are small and sort-merges beyond that.
    """
    quantity = F.col("l_quantity").cast("decimal(18,2)")
    per_order = (
        lines.join(parts.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("lines"),
            F.sum(quantity).alias("quantity"),
            F.sum(quantity * F.coalesce(money(F.col("p_retailprice")), F.lit(0))).alias("list_value"),
        )
    )
    per_customer = (
        orders.select("o_orderkey", "o_custkey", "o_totalprice")
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.count("*").alias("orders"),
            F.sum(money(F.col("o_totalprice"))).alias("spend"),
            F.sum("lines").alias("lines"),
            F.sum("quantity").alias("quantity"),
            F.sum("list_value").alias("list_value"),
        )
    )
    zero = F.lit(0)
    return (
        customers.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            "c_custkey",
            "c_mktsegment",
            "n_name",
            F.coalesce("orders", zero).cast("long").alias("orders"),
            F.coalesce("spend", zero).cast("double").alias("spend"),
            F.coalesce("lines", zero).cast("long").alias("lines"),
            F.coalesce("quantity", zero).cast("double").alias("quantity"),
            F.coalesce("list_value", zero).cast("double").alias("list_value"),
        )
    )


def activity_counts(
    events: DataFrame, key: str, at: str, kind: str, snapshot: str, windows: Sequence[int] = (7, 14),
    kinds: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per key and window: events, events of the named kinds, active days.

    kinds names the columns: by default errors of kind 'error' and purchases of kind 'purchase'.
    """
    kinds = kinds or {"errors": "error", "purchases": "purchase"}
    # one row per key and day first, so that active days need no distinct count
    per_day = events.groupBy(key, F.col(at).cast("date").alias("_day")).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(kind) == k).alias(f"_{name}") for name, k in kinds.items()]
    )
    columns = []
    for days in windows:
        inside = in_window(F.col("_day"), snapshot, -days)
        for name, counted in (("events", "_n"), *((name, f"_{name}") for name in kinds)):
            columns.append(F.sum(F.when(inside, F.col(counted)).otherwise(F.lit(0))).alias(f"{name}_{days}d"))
        columns.append(F.count_if(inside).alias(f"days_active_{days}d"))
    return per_day.groupBy(key).agg(*columns)


def event_type_pivot(events: DataFrame, key: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Events per key and kind, one column per kind."""
    return events.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def account_flows(
    events: DataFrame, key: str, kind: Column, amount: str, external: Column, credit_types: Sequence[str]
) -> DataFrame:
    """Debit and credit counts, net flow, and the external share of debit money, per account."""
    is_debit = direction(kind, credit_types) == "Debit"
    value, zero = money(F.col(amount)), F.lit(0).cast("decimal(18,2)")
    flows = events.groupBy(key).agg(
        F.count_if(is_debit).alias("debit_count"),
        F.count_if(~is_debit).alias("credit_count"),
        F.sum(F.when(is_debit, -value).otherwise(value)).alias("net_flow"),
        F.sum(F.when(is_debit, value).otherwise(zero)).alias("_debit"),
        F.sum(F.when(is_debit & external, value).otherwise(zero)).alias("_external"),
    )
    ratio = safe_ratio(F.col("_external").cast("double"), F.col("_debit").cast("double"), 4)
    return flows.select(
        key, "debit_count", "credit_count", F.col("net_flow").cast("double").alias("net_flow"),
        ratio.alias("external_transfer_ratio"),
    )


def order_totals(
    lines: DataFrame, order_key: str, quantity: str, unit_price: str, discount_rate: str, shipping: str,
    tax_rate: str = fixed.TAX_RATE,
) -> DataFrame:
    """Subtotal, discount, tax and total per order, each rounded to cents in exact decimals.

    The discount applies to the subtotal; line discounts are not taken. Rate and
    shipping belong to the order: the largest value on its lines is used.
    """
    cents = "decimal(18,2)"
    line_total = F.round(F.col(quantity).cast(cents) * F.col(unit_price).cast(cents), 2)
    per_order = lines.groupBy(order_key).agg(
        F.count("*").alias("item_count"),
        F.sum(line_total).cast(cents).alias("subtotal"),
        F.max(F.col(discount_rate).cast("decimal(4,2)")).alias("_rate"),
        F.max(F.col(shipping).cast(cents)).alias("shipping_cost"),
    )
    return _with_totals(per_order, tax_rate).select(
        order_key, "item_count", "subtotal", "shipping_cost", "discount_amount", "tax", "total_amount"
    )


def order_totals_of_items(
    orders: DataFrame, items: str, quantity: str, unit_price: str, discount_rate: str, shipping: str, tax_rate: str = fixed.TAX_RATE
) -> DataFrame:
    """The totals of orders that carry their items as an array of structs, added to each order: no row is shuffled.

    An order without items has a subtotal of 0.
    """
    cents, none = "decimal(18,2)", F.lit(0).cast("decimal(18,2)")

    def add(total: Column, item: Column) -> Column:
        line = F.round(item[quantity].cast(cents) * item[unit_price].cast(cents), 2)
        return (total + F.coalesce(line, none)).cast(cents)

    listed = F.coalesce(F.col(items), F.array().cast(orders.schema[items].dataType))
    per_order = orders.withColumns(
        {
            "item_count": F.size(listed).cast("long"),
            "subtotal": F.aggregate(listed, none, add),
            "_rate": F.col(discount_rate).cast("decimal(4,2)"),
            "shipping_cost": F.col(shipping).cast(cents),
        }
    )
    return _with_totals(per_order, tax_rate).drop("_rate")


def _with_totals(per_order: DataFrame, tax_rate: str) -> DataFrame:
    """Discount on the subtotal, tax on what is left and shipping, total; each in whole cents."""
    cents = "decimal(18,2)"
    discounted = per_order.withColumn("discount_amount", F.round(F.col("subtotal") * F.col("_rate"), 2).cast(cents))
    net = F.col("subtotal") - F.col("discount_amount") + F.col("shipping_cost")
    taxed = discounted.withColumn("tax", F.round(net.cast(cents) * F.lit(tax_rate).cast("decimal(4,2)"), 2).cast(cents))
    return taxed.withColumn("total_amount", (net + F.col("tax")).cast(cents))


def tier_change(customers: DataFrame, key: str, orders: DataFrame, order_key: str, at: str, amount: str, snapshot: str) -> DataFrame:
    """key, tier_last, tier_this, direction: spend quartile of the year before against the last year."""
    zero = F.lit(0).cast("decimal(18,2)")
    value = money(F.col(amount))
    spend = orders.groupBy(F.col(order_key).alias("_key")).agg(
        F.sum(F.when(in_window(F.col(at), snapshot, -365), value).otherwise(zero)).alias("_this"),
        F.sum(F.when(in_window(F.col(at), snapshot, -730, -365), value).otherwise(zero)).alias("_last"),
    )
    base = customers.select(key).join(spend, F.col(key) == F.col("_key"), "left").select(
        key, F.coalesce("_this", zero).alias("_this"), F.coalesce("_last", zero).alias("_last")
    )
    # both years in one sort: the first half of the ranks is of last year, the second of this one
    years = base.select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("_year"), F.col(c).alias("_spend")) for i, c in enumerate(("_last", "_this"))])))
    ranked = global_rank(years, F.col("_year"), F.col("_spend"), F.col(key))
    customers_n = (F.col("total") / 2).cast("long")
    tile = ntile_of(F.col("rank") - F.col("_year") * customers_n, customers_n, 4)
    both = ranked.groupBy(key).agg(
        F.max(F.when(F.col("_year") == 0, tile)).alias("tier_last"), F.max(F.when(F.col("_year") == 1, tile)).alias("tier_this")
    )
    change = (
        F.when(F.col("tier_this") > F.col("tier_last"), fixed.TIER_UP)
        .when(F.col("tier_this") < F.col("tier_last"), fixed.TIER_DOWN)
        .otherwise(fixed.TIER_SAME)
    )
    return both.select(key, "tier_last", "tier_this", change.alias("direction"))
