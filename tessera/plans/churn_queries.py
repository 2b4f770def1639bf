"""Queries on orders, lines, products and events: joins, windows, ratios, labels, feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions import scalars
from tessera.operators import activity, sequences
from tessera.operators.projection import Feature, project
from tessera.operators.snapshots import snapshot_features
from tessera.plans.churn_store import activity_features, churn_features
from tessera.plans.registry import EVENT_SNAPSHOT, RETAIL_SNAPSHOT, query, r, rounded
from tessera.sources.tables import table

SNAP = f"DATE '{RETAIL_SNAPSHOT}'"
MONEY = "CAST(o_totalprice AS DECIMAL(18,2))"
KINDS = ["click", "error", "purchase", "signup", "view"]
CREDIT_KINDS = ["signup", "view"]
CREDIT_SQL = "event_type IN ('signup', 'view')"


def cents_share(amount: str, count: str) -> str:
    """An amount divided by a whole number, rounded half up in whole cents."""
    cents = f"CAST(round({amount} * 100) AS BIGINT)"
    return f"(((2 * {cents} + {count}) // (2 * {count})) / 100e0)"


def _sums(alias: str, value: str, day: str = "o_orderdate") -> str:
    return ", ".join(
        f"CAST(coalesce(sum(CASE WHEN {day} >= {SNAP} - {n} AND {day} < {SNAP} THEN {value} ELSE 0 END), 0) AS {{kind}}) AS {alias}_last_{n}d"
        for n in (30, 90, 365)
    )


RFM = f"""rfm AS (
  SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last_day, min(CAST(o_orderdate AS DATE)) AS first_day,
         count(*) AS total_orders, CAST(sum({MONEY}) AS DOUBLE) AS lifetime_spend,
         {_sums('orders', '1').replace('{kind}', 'BIGINT')}, {_sums('spend', MONEY).replace('{kind}', 'DOUBLE')}
  FROM orders GROUP BY o_custkey)"""
RECENCY = f"CAST(date_diff('day', last_day, {SNAP}) AS INTEGER)"
TRENDS = {
    "avg_order_value_last_90d": f"CASE WHEN orders_last_90d > 0 THEN {cents_share('spend_last_90d', 'orders_last_90d')} ELSE 0e0 END",
    "spend_trend_30_vs_90": "CASE WHEN spend_last_90d > 0 THEN round(spend_last_30d / (spend_last_90d / 3), 3) END",
    "order_freq_trend_90_vs_365": "CASE WHEN orders_last_365d > 0 THEN round(orders_last_90d / (orders_last_365d / 4), 3) END",
}
WINDOWED = [f"{kind}_last_{n}d" for kind in ("orders", "spend") for n in (30, 90, 365)]


def _rfm(spark: SparkSession, sf: str) -> DataFrame:
    return activity.rfm_features(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", RETAIL_SNAPSHOT)


def _doubles(names: list[str]) -> list:
    return [F.col(n).cast("double").alias(n) if n.startswith("spend") else F.col(n) for n in names]


@query(f"""WITH {RFM} SELECT o_custkey, strftime(last_day, '%Y-%m-%d') AS last_purchase_date, total_orders, lifetime_spend,
{cents_share('lifetime_spend', 'total_orders')} AS average_order_value, {RECENCY} AS days_since_last_purchase, {', '.join(WINDOWED)} FROM rfm""")
def rfm_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rfm(spark, sf).select(
        "o_custkey", F.date_format("last_purchase_date", "yyyy-MM-dd").alias("last_purchase_date"), "total_orders",
        F.col("lifetime_spend").cast("double").alias("lifetime_spend"), "average_order_value", "days_since_last_purchase",
        *_doubles(WINDOWED),
    )


@query(f"WITH {RFM} SELECT o_custkey, {', '.join(f'{e} AS {n}' for n, e in TRENDS.items())} FROM rfm")
def trend_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rfm(spark, sf).select("o_custkey", *[c.alias(n) for n, c in activity.trend_columns().items()])


@query(f"""WITH {RFM} SELECT o_custkey, {RECENCY} AS days_inactive,
{r(f"0.25 + 0.75 * 0.6 / (1 + exp(-0.02 * ({RECENCY} - 60)))", 6)} AS retail_propensity,
{r(f"0.20 + 0.80 * 0.6 / (1 + exp(-0.02 * ({RECENCY} - 60)))", 6)} AS fintech_propensity FROM rfm""")
def churn_propensity(spark: SparkSession, sf: str) -> DataFrame:
    days = F.col("days_since_last_purchase")
    return _rfm(spark, sf).select(
        "o_custkey", days.alias("days_inactive"),
        rounded(scalars.churn_propensity(days.cast("double")), 6).alias("retail_propensity"),
        rounded(scalars.churn_propensity(days.cast("double"), fixed.FINTECH_BASE_RATE), 6).alias("fintech_propensity"),
    )


@query(f"""WITH {RFM} SELECT c_custkey, CAST(date_diff('day', first_day, {SNAP}) AS INTEGER) AS tenure_days,
CAST(floor(date_diff('day', first_day, {SNAP}) / 365) AS INTEGER) AS age_years
FROM customer LEFT JOIN rfm ON c_custkey = o_custkey""")
def tenure_age(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "customer").join(_rfm(spark, sf), F.col("c_custkey") == F.col("o_custkey"), "left")
    day = F.lit(RETAIL_SNAPSHOT).cast("date")
    first = F.col("first_purchase_date")
    return joined.select(
        "c_custkey", scalars.days_between(first, day).alias("tenure_days"), scalars.age_years(first, day).alias("age_years")
    )


ACTIVE = f"active AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= {SNAP} AND o_orderdate < {SNAP} + 90)"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return activity.churn_labels(
        table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "o_orderdate", RETAIL_SNAPSHOT
    )


@query(f"""WITH {ACTIVE} SELECT c_custkey, CAST(CASE WHEN k IS NULL THEN 1 ELSE 0 END AS INTEGER) AS churn_label
FROM customer LEFT JOIN active ON c_custkey = k""")
def churn_label_window(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf)


@query(f"""WITH {ACTIVE} SELECT count(*) AS customers, count(*) - count(k) AS churned,
{r('100.0 * (count(*) - count(k)) / count(*)', 1)} AS churn_rate FROM customer LEFT JOIN active ON c_custkey = k""")
def churn_rate(spark: SparkSession, sf: str) -> DataFrame:
    return activity.churn_rate(_labels(spark, sf)).withColumn("churn_rate", rounded("churn_rate", 1))


BOUGHT = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"""SELECT o_custkey, count(DISTINCT p_type) AS distinct_categories, count(DISTINCT p_brand) AS distinct_brands
{BOUGHT} JOIN part ON l_partkey = p_partkey GROUP BY o_custkey""")
def product_breadth(spark: SparkSession, sf: str) -> DataFrame:
    return activity.product_breadth(table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "part"))


RETURNED_YEAR = f"count(*) FILTER (WHERE l_returnflag = 'R' AND l_shipdate >= {SNAP} - 365 AND l_shipdate < {SNAP})"
RETURNED_SHARE = "round(CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*), 4)"


@query(f"SELECT o_custkey, {RETURNED_YEAR} AS returns_last_12m, {RETURNED_SHARE} AS returns_rate {BOUGHT} GROUP BY o_custkey")
def returns_rate(spark: SparkSession, sf: str) -> DataFrame:
    return activity.returns_rate(table(spark, sf, "lineitem"), table(spark, sf, "orders"), RETAIL_SNAPSHOT)


@query(f"""WITH buyers AS (SELECT l_partkey, o_custkey, count(DISTINCT l_orderkey) AS times,
  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned {BOUGHT} GROUP BY l_partkey, o_custkey)
SELECT l_partkey, count(*) AS buyers, {r('avg(returned)', 4)} AS return_rate,
       {r('avg(CASE WHEN times >= 2 THEN 1 ELSE 0 END)', 4)} AS repeat_purchase_rate FROM buyers GROUP BY l_partkey""")
def product_signals(spark: SparkSession, sf: str) -> DataFrame:
    found = activity.product_signals(table(spark, sf, "lineitem"), table(spark, sf, "orders"))
    return found.withColumn("return_rate", rounded("return_rate", 4)).withColumn(
        "repeat_purchase_rate", rounded("repeat_purchase_rate", 4)
    )


@query(f"""WITH lines AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q,
  sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(coalesce(p_retailprice, 0) AS DECIMAL(18,2))) AS v
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
bought AS (SELECT o_custkey, count(*) AS orders, sum({MONEY}) AS spend, sum(n) AS lines, sum(q) AS quantity, sum(v) AS list_value
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT c_custkey, c_mktsegment, n_name, CAST(coalesce(orders, 0) AS BIGINT) AS orders, CAST(coalesce(spend, 0) AS DOUBLE) AS spend,
       CAST(coalesce(lines, 0) AS BIGINT) AS lines, CAST(coalesce(quantity, 0) AS DOUBLE) AS quantity, CAST(coalesce(list_value, 0) AS DOUBLE) AS list_value
FROM customer LEFT JOIN bought ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def customer_360(spark: SparkSession, sf: str) -> DataFrame:
    names = ("customer", "nation", "orders", "lineitem", "part")
    return activity.customer_360(*[table(spark, sf, n) for n in names])


@query(f"""WITH priced AS (SELECT l_orderkey, round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)), 2) AS line_total,
  CAST(l_discount AS DECIMAL(4,2)) AS rate, CAST(l_linenumber AS DECIMAL(18,2)) AS shipping FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT l_orderkey, count(*) AS item_count, CAST(sum(line_total) AS DECIMAL(18,2)) AS subtotal, max(rate) AS rate, max(shipping) AS shipping FROM priced GROUP BY l_orderkey),
b AS (SELECT *, CAST(round(subtotal * rate, 2) AS DECIMAL(18,2)) AS discount FROM a),
c AS (SELECT *, CAST(round(CAST(subtotal - discount + shipping AS DECIMAL(18,2)) * CAST(0.10 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS tax FROM b)
SELECT l_orderkey, item_count, CAST(subtotal AS DOUBLE) AS subtotal, CAST(shipping AS DOUBLE) AS shipping_cost, CAST(discount AS DOUBLE) AS discount_amount,
       CAST(tax AS DOUBLE) AS tax, CAST(subtotal - discount + shipping + tax AS DOUBLE) AS total_amount FROM c""")
def order_totals(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    lines = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    totals = activity.order_totals(lines, "l_orderkey", "l_quantity", "p_retailprice", "l_discount", "l_linenumber")
    amounts = ("subtotal", "shipping_cost", "discount_amount", "tax", "total_amount")
    return totals.select("l_orderkey", "item_count", *[F.col(a).cast("double").alias(a) for a in amounts])


NESTED_TOTALS = """WITH items AS (SELECT l_orderkey, count(*) AS n, sum(round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)), 2)) AS v
  FROM lineitem GROUP BY l_orderkey),
a AS (SELECT o_orderkey, coalesce(n, 0) AS item_count, CAST(coalesce(v, 0) AS DECIMAL(18,2)) AS subtotal, CAST(0.05 AS DECIMAL(4,2)) AS rate,
  CAST(9.99 AS DECIMAL(18,2)) AS shipping FROM orders LEFT JOIN items ON l_orderkey = o_orderkey),
b AS (SELECT *, CAST(round(subtotal * rate, 2) AS DECIMAL(18,2)) AS discount FROM a),
c AS (SELECT *, CAST(round(CAST(subtotal - discount + shipping AS DECIMAL(18,2)) * CAST(0.10 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS tax FROM b)
SELECT o_orderkey, item_count, CAST(subtotal AS DOUBLE) AS subtotal, CAST(discount AS DOUBLE) AS discount_amount, CAST(tax AS DOUBLE) AS tax,
       CAST(subtotal - discount + shipping + tax AS DOUBLE) AS total_amount FROM c"""


@query(NESTED_TOTALS)
def order_totals_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that carry their lines as an array, as an order record has them."""
    item = F.struct(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    # the lines of one order are one record by nature
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    orders = table(spark, sf, "orders").select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    priced = orders.select("o_orderkey", "items", F.lit("0.05").alias("rate"), F.lit("9.99").alias("shipping"))
    totals = activity.order_totals_of_items(priced, "items", "quantity", "price", "rate", "shipping")
    amounts = ("subtotal", "discount_amount", "tax", "total_amount")
    return totals.select("o_orderkey", "item_count", *[F.col(a).cast("double").alias(a) for a in amounts])


ACTIVITY_SQL = ", ".join(
    f"""count(*) FILTER (WHERE inside_{n}) AS events_{n}d, count(*) FILTER (WHERE inside_{n} AND event_type = 'error') AS errors_{n}d,
count(*) FILTER (WHERE inside_{n} AND event_type = 'purchase') AS purchases_{n}d, count(DISTINCT CASE WHEN inside_{n} THEN CAST(ts AS DATE) END) AS days_active_{n}d"""
    for n in (7, 14)
)
INSIDE_SQL = ", ".join(f"ts >= DATE '{EVENT_SNAPSHOT}' - {n} AND ts < DATE '{EVENT_SNAPSHOT}' AS inside_{n}" for n in (7, 14))


@query(f"WITH e AS (SELECT *, {INSIDE_SQL} FROM events) SELECT user_id, {ACTIVITY_SQL} FROM e GROUP BY user_id")
def activity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return activity.activity_counts(table(spark, sf, "events"), "user_id", "ts", "event_type", EVENT_SNAPSHOT)


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def event_type_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return activity.event_type_pivot(table(spark, sf, "events"), "user_id", "event_type", KINDS)


@query(f"""WITH e AS (SELECT user_id, {CREDIT_SQL} AS credit, CAST(value AS DECIMAL(18,2)) AS v,
  CAST(json_extract(props, '$.k') AS INTEGER) >= 50 AS outside FROM events),
f AS (SELECT user_id, count(*) FILTER (WHERE NOT credit) AS debit_count, count(*) FILTER (WHERE credit) AS credit_count,
  sum(CASE WHEN credit THEN v ELSE -v END) AS net, sum(CASE WHEN credit THEN 0 ELSE v END) AS debit,
  sum(CASE WHEN NOT credit AND outside THEN v ELSE 0 END) AS ext FROM e GROUP BY user_id)
SELECT user_id, debit_count, credit_count, CAST(net AS DOUBLE) AS net_flow,
       CASE WHEN debit > 0 THEN round(CAST(ext AS DOUBLE) / CAST(debit AS DOUBLE), 4) END AS external_transfer_ratio FROM f""")
def account_flows(spark: SparkSession, sf: str) -> DataFrame:
    external = F.get_json_object("props", "$.k").cast("int") >= 50
    return activity.account_flows(table(spark, sf, "events"), "user_id", F.col("event_type"), "value", external, CREDIT_KINDS)


@query("""SELECT o_orderkey, o_custkey, CAST(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE)) AS INTEGER) AS days_since_previous
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def days_since_prev_order(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.days_since_previous(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT event_id, user_id, CAST(date_diff('day', lag(CAST(ts AS DATE)) OVER w, CAST(ts AS DATE)) AS INTEGER) AS days_since_previous
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def days_since_prev_event(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.days_since_previous(table(spark, sf, "events"), "user_id", "event_id", "ts")


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_first FROM orders""")
def first_order_flag(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.first_flags(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


GAPS = """gaps AS (SELECT o_custkey, date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), CAST(o_orderdate AS DATE)) AS gap FROM orders)"""


@query(f"""WITH {GAPS} SELECT o_custkey, count(gap) AS gaps, {r('avg(gap)', 4)} AS avg_gap_days, {r('stddev_samp(gap)', 4)} AS gap_std_days
FROM gaps GROUP BY o_custkey""")
def interpurchase_gaps(spark: SparkSession, sf: str) -> DataFrame:
    found = sequences.gap_statistics(table(spark, sf, "orders"), "o_custkey", "o_orderdate")
    return found.select("o_custkey", "gaps", rounded("avg_gap_days", 4).alias("avg_gap_days"), rounded("gap_std_days", 4).alias("gap_std_days"))


@query(f"""SELECT o_orderkey, o_custkey, CAST(sum({MONEY}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total FROM orders""")
def running_spend(spark: SparkSession, sf: str) -> DataFrame:
    found = sequences.running_total(
        table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"],
        scalars.money(F.col("o_totalprice")), ["o_orderkey", "o_custkey"],
    )
    return found.withColumn("running_total", F.col("running_total").cast("double"))


@query(f"""WITH flow AS (SELECT event_id, user_id, ts, CASE WHEN {CREDIT_SQL} THEN CAST(value AS DECIMAL(18,2)) ELSE -CAST(value AS DECIMAL(18,2)) END AS amount FROM events)
SELECT event_id, user_id, CAST(sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total FROM flow""")
def running_balance(spark: SparkSession, sf: str) -> DataFrame:
    value = scalars.money(F.col("value"))
    signed = F.when(scalars.direction(F.col("event_type"), CREDIT_KINDS) == "Credit", value).otherwise(-value)
    found = sequences.running_total(table(spark, sf, "events"), "user_id", ["ts", "event_id"], signed, ["event_id", "user_id"])
    return found.withColumn("running_total", F.col("running_total").cast("double"))


@query(f"""WITH days AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, sum({MONEY}) AS s FROM orders GROUP BY 1, 2)
SELECT o_custkey, strftime(d, '%Y-%m-%d') AS day, CAST(sum(s) OVER (PARTITION BY o_custkey ORDER BY d
RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) AS rolling_sum FROM days""")
def spend_rolling_30d(spark: SparkSession, sf: str) -> DataFrame:
    found = sequences.rolling_sum(table(spark, sf, "orders"), "o_custkey", "o_orderdate", scalars.money(F.col("o_totalprice")), 30)
    return found.select("o_custkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("rolling_sum").cast("double").alias("rolling_sum"))


@query(f"""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT user_id, ts FROM e WHERE p IS NULL OR ts - p > INTERVAL 30 MINUTES)
SELECT user_id, count(*) AS sessions, count(*) FILTER (WHERE ts >= DATE '{EVENT_SNAPSHOT}' - 7 AND ts < DATE '{EVENT_SNAPSHOT}') AS sessions_7d,
       count(*) FILTER (WHERE ts >= DATE '{EVENT_SNAPSHOT}' - 14 AND ts < DATE '{EVENT_SNAPSHOT}') AS sessions_14d FROM s GROUP BY user_id""")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    starts = sequences.sessions(table(spark, sf, "events"), "user_id", "ts")
    inside = [
        F.count_if(activity.in_window(F.col("started"), EVENT_SNAPSHOT, -n)).alias(f"sessions_{n}d") for n in (7, 14)
    ]
    return starts.groupBy("user_id").agg(F.count("*").alias("sessions"), *inside)


TIERS = f"""spend AS (SELECT c_custkey,
  coalesce(sum(CASE WHEN o_orderdate >= {SNAP} - 365 AND o_orderdate < {SNAP} THEN {MONEY} END), 0) AS this_year,
  coalesce(sum(CASE WHEN o_orderdate >= {SNAP} - 730 AND o_orderdate < {SNAP} - 365 THEN {MONEY} END), 0) AS last_year
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey),
tiers AS (SELECT c_custkey, ntile(4) OVER (ORDER BY last_year, c_custkey) AS tier_last, ntile(4) OVER (ORDER BY this_year, c_custkey) AS tier_this FROM spend),
changes AS (SELECT *, CASE WHEN tier_this > tier_last THEN 'Upgraded' WHEN tier_this < tier_last THEN 'Downgraded' ELSE 'No Change' END AS direction FROM tiers)"""


@query(f"WITH {TIERS} SELECT c_custkey, CAST(tier_last AS INTEGER) AS tier_last, CAST(tier_this AS INTEGER) AS tier_this, direction FROM changes")
def tier_change(spark: SparkSession, sf: str) -> DataFrame:
    return activity.tier_change(
        table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", RETAIL_SNAPSHOT
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN '<50k' WHEN o_totalprice < 100000 THEN '50-100k'
WHEN o_totalprice < 150000 THEN '100-150k' ELSE '>150k' END AS band FROM orders""")
def value_band(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", scalars.banded(F.col("o_totalprice")).alias("band"))


@query(f"SELECT event_id, CASE WHEN {CREDIT_SQL} THEN 'Credit' ELSE 'Debit' END AS direction FROM events")
def txn_direction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", scalars.direction(F.col("event_type"), CREDIT_KINDS).alias("direction"))


@query(f"SELECT event_id, value > 100 AND NOT ({CREDIT_SQL}) AS large_outflow_flag FROM events")
def large_outflow_flag(spark: SparkSession, sf: str) -> DataFrame:
    flag = scalars.large_outflow(F.col("value"), F.col("event_type"), CREDIT_KINDS, 100)
    return table(spark, sf, "events").select("event_id", flag.alias("large_outflow_flag"))


@query(f"""WITH loans AS (SELECT o_orderkey, o_totalprice AS p, CAST(left(o_orderpriority, 1) AS DOUBLE) - 1 AS rate, 12 * CAST(left(o_orderpriority, 1) AS INTEGER) AS months FROM orders)
SELECT o_orderkey, {r(f"CASE WHEN rate = 0 THEN {cents_share('p', 'months')} ELSE p * (rate / 1200e0) / (1 - pow(1 + rate / 1200e0, -months)) END", 2)} AS monthly_repayment FROM loans""")
def loan_repayment(spark: SparkSession, sf: str) -> DataFrame:
    grade = F.substring("o_orderpriority", 1, 1)
    found = scalars.loan_repayment(F.col("o_totalprice"), grade.cast("double") - 1, grade.cast("int") * 12)
    return table(spark, sf, "orders").select("o_orderkey", rounded(found, 2).alias("monthly_repayment"))


@query("""SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(1 + p_size / 100.0 AS DECIMAL(8,4)), 2) AS DOUBLE) AS price,
round(CAST(p_size AS DOUBLE), 1) AS margin_pct FROM part""")
def price_margin(spark: SparkSession, sf: str) -> DataFrame:
    margin = F.col("p_size") / F.lit(100.0)
    return table(spark, sf, "part").select(
        "p_partkey", scalars.price_from_margin(F.col("p_retailprice"), margin).cast("double").alias("price"),
        F.round(margin * 100, 1).alias("margin_pct"),
    )


@query("""SELECT c_custkey, 'CUST-' || lpad(CAST(c_custkey + 1 AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey + 1 AS VARCHAR))) AS INTEGER), '0') AS customer_id FROM customer""")
def padded_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", scalars.padded_id("CUST", F.col("c_custkey") + 1).alias("customer_id"))


@query("""SELECT event_id, CASE WHEN event_type IN ('purchase', 'error') THEN props END AS merchant,
CASE WHEN event_type = 'purchase' THEN value END AS spent, CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d') END AS failed_on FROM events""")
def conditional_nulls(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        F.when(kind.isin("purchase", "error"), F.col("props")).alias("merchant"),
        F.when(kind == "purchase", F.col("value")).alias("spent"),
        F.when(kind == "error", F.date_format("ts", "yyyy-MM-dd")).alias("failed_on"),
    )


@query("""WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'not json ' || props ELSE props END AS text FROM events)
SELECT event_id, coalesce(CASE WHEN json_valid(text) THEN CAST(json_extract(text, '$.k') AS INTEGER) END, -1) AS k, json_valid(text) AS readable FROM t""")
def json_fallback(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("not json "), "props")).otherwise(F.col("props"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    parsed = table(spark, sf, "events").select("event_id", F.from_json(text, "k INT, broken STRING", options).alias("a"))
    return parsed.select("event_id", F.coalesce("a.k", F.lit(-1)).alias("k"), F.col("a.broken").isNull().alias("readable"))


# features know the orders made and the lines shipped before the snapshot; the label alone knows later orders
EARLIER = f"""earlier AS (SELECT * FROM orders WHERE o_orderdate < {SNAP}),
shipped AS (SELECT * FROM lineitem JOIN earlier ON l_orderkey = o_orderkey WHERE l_shipdate < {SNAP})"""

STORE_SQL = f"""WITH {EARLIER}, {RFM.replace('FROM orders', 'FROM earlier')}, {GAPS.replace('FROM orders', 'FROM earlier')}, {ACTIVE}, {TIERS},
gap_stats AS (SELECT o_custkey AS gk, {r('avg(gap)', 4)} AS avg_gap, {r('stddev_samp(gap)', 4)} AS sd_gap FROM gaps GROUP BY o_custkey),
items AS (SELECT o_custkey AS ik, {RETURNED_YEAR} AS returns_last_12m, {RETURNED_SHARE} AS returns_rate,
  count(DISTINCT p_type) AS types, count(DISTINCT p_brand) AS brands FROM shipped LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_custkey)
SELECT customer.c_custkey AS customer_id, '{RETAIL_SNAPSHOT}' AS model_snapshot_date,
  CAST(date_diff('day', first_day, {SNAP}) AS INTEGER) AS tenure_days,
  CAST(floor(date_diff('day', first_day, {SNAP}) / 365) AS INTEGER) AS tenure_years,
  c_mktsegment AS acquisition_source,
  CASE WHEN c_acctbal < 0 THEN '<0' WHEN c_acctbal < 2500 THEN '0-2500' WHEN c_acctbal < 5000 THEN '2500-5000' ELSE '>5000' END AS balance_band,
  {RECENCY} AS days_since_last_purchase,
  {', '.join(f"coalesce({w}, 0) AS {w}" for w in WINDOWED)},
  avg_gap AS avg_days_between_orders, sd_gap AS inter_purchase_variance,
  coalesce(lifetime_spend, 0) AS lifetime_spend, coalesce(total_orders, 0) AS total_orders,
  coalesce({cents_share('lifetime_spend', 'total_orders')}, 0e0) AS average_order_value,
  {', '.join(f"{e} AS {n}" for n, e in TRENDS.items())},
  CAST(rfm.o_custkey IS NOT NULL AS INTEGER) AS has_ordered,
  coalesce(returns_last_12m, 0) AS returns_last_12m, returns_rate,
  coalesce(types, 0) AS distinct_categories_purchased, coalesce(brands, 0) AS distinct_brands_purchased,
  CAST(CASE WHEN k IS NULL THEN 1 ELSE 0 END AS INTEGER) AS churn_label,
  {r(f"0.25 + 0.75 * 0.6 / (1 + exp(-0.02 * ({RECENCY} - 60)))", 6)} AS churn_propensity,
  CAST(365 AS INTEGER) AS observation_window_days, CAST(90 AS INTEGER) AS prediction_window_days,
  direction AS loyalty_tier_change_direction
FROM customer LEFT JOIN rfm ON customer.c_custkey = rfm.o_custkey LEFT JOIN gap_stats ON customer.c_custkey = gk
LEFT JOIN active ON customer.c_custkey = k LEFT JOIN items ON customer.c_custkey = ik JOIN changes ON changes.c_custkey = customer.c_custkey"""


@query(STORE_SQL)
def churn_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    names = ("customer", "orders", "lineitem", "part")
    features = churn_features(*[table(spark, sf, n) for n in names], RETAIL_SNAPSHOT, with_tier_change=True)
    return features.withColumn("model_snapshot_date", F.date_format("model_snapshot_date", "yyyy-MM-dd"))


ACTIVITY_SNAPSHOT = "2024-01-24"
A_SNAP = f"DATE '{ACTIVITY_SNAPSHOT}'"
INSIDE = {n: f"ts >= {A_SNAP} - {n} AND ts < {A_SNAP}" for n in (7, 14)}


@query(f"""WITH e AS (SELECT *, CAST(ts AS DATE) AS d, {CREDIT_SQL} AS credit, CAST(value AS DECIMAL(18,2)) AS v,
  coalesce(CAST(json_extract(props, '$.k') AS INTEGER) >= 50, false) AS outside,
  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT * FROM e WHERE ts < {A_SNAP}),
numbered AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTES THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM b),
visits AS (SELECT user_id, session, min(ts) AS started, max(ts) AS ended FROM numbered GROUP BY user_id, session),
per_visit AS (SELECT user_id AS vu, {', '.join(f"count(*) FILTER (WHERE {c.replace('ts ', 'started ')}) AS app_sessions_last_{n}d" for n, c in INSIDE.items())},
  {r("avg((epoch_us(ended) - epoch_us(started)) / 60e6)", 4)} AS avg_session_duration_mins FROM visits GROUP BY user_id),
users AS (SELECT user_id, CAST(count(*) FILTER (WHERE d >= {A_SNAP} AND d < {A_SNAP} + 1) = 0 AS INTEGER) AS churn_label FROM e GROUP BY user_id),
per_user AS (SELECT user_id AS bu,
  CAST(date_diff('day', min(d), {A_SNAP}) AS INTEGER) AS tenure_days, CAST(date_diff('day', max(d), {A_SNAP}) AS INTEGER) AS days_since_last_activity,
  CAST(date_diff('day', max(CASE WHEN event_type = 'purchase' THEN d END), {A_SNAP}) AS INTEGER) AS days_since_last_transaction,
  {', '.join(f"count(*) FILTER (WHERE {c}) AS events_last_{n}d, count(DISTINCT CASE WHEN {c} THEN d END) AS days_active_last_{n}d, count(*) FILTER (WHERE {c} AND event_type = 'error') AS failed_last_{n}d" for n, c in INSIDE.items())},
  {', '.join(f"CAST(sum(CASE WHEN {c} THEN CASE WHEN credit THEN v ELSE -v END ELSE 0 END) AS DOUBLE) AS balance_trend_{n}d" for n, c in INSIDE.items())},
  CAST(sum(CASE WHEN credit THEN 0 ELSE v END) AS DOUBLE) AS debit, CAST(sum(CASE WHEN NOT credit AND outside THEN v ELSE 0 END) AS DOUBLE) AS ext,
  CAST(max(CASE WHEN NOT credit AND outside AND value > 100 THEN 1 ELSE 0 END) AS INTEGER) AS large_external_transfer_flag FROM b GROUP BY user_id)
SELECT user_id, '{ACTIVITY_SNAPSHOT}' AS model_snapshot_date, tenure_days, days_since_last_activity, days_since_last_transaction,
  {', '.join(f"coalesce(events_last_{n}d, 0) AS events_last_{n}d, coalesce(days_active_last_{n}d, 0) AS days_active_last_{n}d, coalesce(failed_last_{n}d, 0) AS failed_last_{n}d, coalesce(balance_trend_{n}d, 0) AS balance_trend_{n}d, coalesce(app_sessions_last_{n}d, 0) AS app_sessions_last_{n}d" for n in INSIDE)},
  avg_session_duration_mins, CASE WHEN debit > 0 THEN round(ext / debit, 4) END AS external_transfer_ratio,
  coalesce(large_external_transfer_flag, 0) AS large_external_transfer_flag,
  churn_label, {r("0.20 + 0.80 * 0.6 / (1 + exp(-0.02 * (days_since_last_activity - 60)))", 6)} AS churn_propensity,
  CAST(14 AS INTEGER) AS observation_window_days, CAST(1 AS INTEGER) AS prediction_window_days
FROM users LEFT JOIN per_user ON bu = user_id LEFT JOIN per_visit ON vu = user_id""")
def activity_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    external = F.get_json_object("props", "$.k").cast("int") >= 50
    features = activity_features(
        table(spark, sf, "events"), ACTIVITY_SNAPSHOT, external, credit_types=CREDIT_KINDS, large=100, window_days=1
    )
    return features.select(
        "*", F.date_format("model_snapshot_date", "yyyy-MM-dd").alias("_day"),
        rounded("avg_session_duration_mins", 4).alias("_minutes"),
    ).drop("model_snapshot_date", "avg_session_duration_mins").withColumnsRenamed(
        {"_day": "model_snapshot_date", "_minutes": "avg_session_duration_mins"}
    )


MONTHS = [f"1998-{month:02}-01" for month in range(1, 13)]


@query(f"""WITH snaps AS (SELECT unnest([{', '.join(f"DATE '{m}'" for m in MONTHS)}]) AS snapshot),
days AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n, sum({MONEY}) AS spend FROM orders GROUP BY ALL),
sums AS (SELECT o_custkey, snapshot,
  sum(n) FILTER (d < snapshot) AS total_orders, sum(spend) FILTER (d < snapshot) AS lifetime_spend,
  {', '.join(f"sum(n) FILTER (d < snapshot AND d >= snapshot - {w}) AS orders_last_{w}d, sum(spend) FILTER (d < snapshot AND d >= snapshot - {w}) AS spend_last_{w}d" for w in (30, 90, 365))},
  min(date_diff('day', d, snapshot)) FILTER (d < snapshot) AS days_since_last_purchase,
  count(*) FILTER (d >= snapshot AND d < snapshot + 90) AS later FROM days, snaps GROUP BY o_custkey, snapshot)
SELECT c_custkey AS customer_id, CAST(snaps.snapshot AS VARCHAR) AS snapshot, CAST(coalesce(total_orders, 0) AS BIGINT) AS total_orders,
  {', '.join(f"CAST(coalesce(orders_last_{w}d, 0) AS BIGINT) AS orders_last_{w}d, coalesce(CAST(spend_last_{w}d AS DOUBLE), 0e0) AS spend_last_{w}d" for w in (30, 90, 365))},
  coalesce(CAST(lifetime_spend AS DOUBLE), 0e0) AS lifetime_spend, CAST(days_since_last_purchase AS INTEGER) AS days_since_last_purchase,
  CASE WHEN coalesce(later, 0) = 0 THEN 1 ELSE 0 END AS churn_label
FROM customer CROSS JOIN snaps LEFT JOIN sums ON o_custkey = c_custkey AND sums.snapshot = snaps.snapshot""")
def churn_features_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Features and churn label of all customers at the start of twelve months, from one scan of the orders."""
    found = snapshot_features(
        table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", MONTHS, label_days=90
    )
    return found.withColumn("snapshot", F.col("snapshot").cast("string"))


#: The declared features of the nested record below.
WIDE = (
    Feature("balance", "account.balance", to="double"),
    Feature("segment", "account.segment", default="none"),
    Feature("in_debt", "account.in_debt", "flag"),
    Feature("has_ordered", "orders.first", "present"),
    Feature("years_a_customer", "orders.first", "age", default=0),
    Feature("days_inactive", "orders.last", "days", default=-1),
    Feature("large_share", "orders.large", "ratio", by="orders.number", digits=4, default=0.0),
    Feature("orders", "orders.number", to="bigint", default=0),
)


@query(f"""WITH o AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, count(*) AS number,
  count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_acctbal AS balance, coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, 'none') AS segment,
  CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS in_debt, CASE WHEN first IS NULL THEN 0 ELSE 1 END AS has_ordered,
  CAST(coalesce(floor(date_diff('day', first, {SNAP}) / 365e0), 0) AS INTEGER) AS years_a_customer,
  CAST(coalesce(date_diff('day', last, {SNAP}), -1) AS INTEGER) AS days_inactive,
  {r('coalesce(large / number, 0)', 4)} AS large_share, CAST(coalesce(number, 0) AS BIGINT) AS orders
FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def wide_record_features(spark: SparkSession, sf: str) -> DataFrame:
    """A declared projection of a nested customer record: flags with and without a value, dates, a ratio, defaults."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("first"), F.max(F.col("o_orderdate").cast("date")).alias("last"),
        F.count("*").alias("number"), F.count_if(F.col("o_totalprice") > 100000).alias("large"),
    )
    joined = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    record = joined.select(
        "c_custkey",
        F.struct(
            F.col("c_acctbal").alias("balance"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
            F.when(F.col("c_acctbal") < 0, F.lit(True)).when(F.col("c_acctbal") > 5000, F.lit(False)).alias("in_debt"),  # else unknown
        ).alias("account"),
        F.when(F.col("o_custkey").isNotNull(), F.struct("first", "last", "number", "large")).alias("orders"),
    )
    made = project(record, WIDE, ["c_custkey"], RETAIL_SNAPSHOT)
    return made.withColumn("large_share", rounded("large_share", 4))
