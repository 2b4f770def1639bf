import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import activity, ranking, sequences

random.seed(3)
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def visits():
    """One key owns a third of the rows; many rows share a moment."""
    rows = []
    for i in range(600):
        key = 1 if i % 3 == 0 else random.randint(2, 40)
        rows.append((i, key, START + dt.timedelta(minutes=random.choice([10, 30, 700]) * random.randint(0, 60)), round(random.random() * 100, 2)))
    return pd.DataFrame(rows, columns=["id", "key", "at", "amount"])


@pytest.fixture(scope="module")
def frame(spark, visits):
    return spark.createDataFrame(visits, "id LONG, key LONG, at TIMESTAMP_NTZ, amount DOUBLE").repartition(4)


@pytest.fixture(scope="module")
def ordered(visits):
    return visits.sort_values(["key", "at", "id"])


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_days_since_previous(frame, ordered):
    day = ordered["at"].dt.normalize()
    gaps = (day - day.groupby(ordered["key"]).shift()).dt.days
    want = {i: None if np.isnan(g) else int(g) for i, g in zip(ordered["id"], gaps)}
    assert by_id(sequences.days_since_previous(frame, "key", "id", "at"), "days_since_previous") == want


def test_first_flags(frame, ordered):
    first = ordered.groupby("key")["id"].first()
    got = by_id(sequences.first_flags(frame, "key", "id", "at"), "is_first")
    assert {i for i, flag in got.items() if flag} == set(first) and len(got) == 600


def test_gap_statistics(frame, ordered):
    day = ordered["at"].dt.normalize()
    gaps = (day - day.groupby(ordered["key"]).shift()).dt.days
    for row in sequences.gap_statistics(frame, "key", "at").collect():
        mine = gaps[ordered["key"] == row["key"]].dropna()
        assert row["gaps"] == len(mine)
        assert (row["avg_gap_days"] is None) == (len(mine) == 0)
        if len(mine) > 1:
            assert row["gap_std_days"] == pytest.approx(mine.std())
        else:
            assert row["gap_std_days"] is None


def test_running_total(spark, frame, ordered):
    # 600 rows sorted into 40 tasks: the hot key is spread over many of them
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        total = sequences.running_total(frame, "key", ["at", "id"], scalars.money(F.col("amount")), ["id", "key"])
        got = by_id(total, "running_total")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    cents = (ordered["amount"] * 100).round().astype(int).groupby(ordered["key"]).cumsum()
    assert {i: round(v * 100) for i, v in got.items()} == dict(zip(ordered["id"], cents))


def test_running_total_treats_missing_keys_as_one(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0), (3, 5, 4.0)], "id LONG, key LONG, amount DOUBLE").repartition(3)
    total = sequences.running_total(df, "key", ["id"], scalars.money(F.col("amount")), ["id"])
    assert {i: float(v) for i, v in by_id(total, "running_total").items()} == {1: 1.0, 2: 3.0, 3: 4.0}


def test_rolling_sum(frame, visits):
    daily = visits.assign(day=visits["at"].dt.date).groupby(["key", "day"])["amount"].sum()
    for row in sequences.rolling_sum(frame, "key", "at", scalars.money(F.col("amount")), 7).collect():
        mine = daily[row["key"]]
        inside = [v for d, v in mine.items() if 0 <= (row["day"] - d).days < 7]
        assert float(row["rolling_sum"]) == pytest.approx(sum(inside))


def test_sessions(frame, ordered):
    gap = ordered["at"] - ordered.groupby("key")["at"].shift()
    starts = ordered[gap.isna() | (gap > pd.Timedelta(minutes=30))]
    got = sequences.sessions(frame, "key", "at").collect()
    assert sorted((r["key"], r["started"]) for r in got) == sorted((k, a.to_pydatetime()) for k, a in zip(starts["key"], starts["at"]))
    assert sum(r["events"] for r in got) == len(ordered)
    number = (gap.isna() | (gap > pd.Timedelta(minutes=30))).groupby(ordered["key"]).cumsum()
    ends = ordered.groupby([ordered["key"], number])["at"].max()
    assert {(r["key"], r["session"]): r["ended"] for r in got} == {k: v.to_pydatetime() for k, v in ends.items()}


def test_pause_of_exactly_the_gap_does_not_end_a_session(spark):
    rows = [(1, START), (1, START + dt.timedelta(minutes=30)), (1, START + dt.timedelta(minutes=60, seconds=1))]
    assert sequences.sessions(spark.createDataFrame(rows, "key INT, at TIMESTAMP_NTZ"), "key", "at").count() == 2


@pytest.mark.parametrize("rows, groups", [(10, 4), (3, 4), (8, 4), (1, 4), (101, 7)])
def test_ntile(spark, rows, groups):
    df = spark.range(rows, numPartitions=5).withColumn("v", (F.col("id") * 37) % 11)
    df.createOrReplaceTempView("numbered")
    want = {r["id"]: r["t"] for r in spark.sql(f"SELECT id, ntile({groups}) OVER (ORDER BY v, id) AS t FROM numbered").collect()}
    assert by_id(ranking.ntile(df, groups, F.col("v"), F.col("id")), "tile") == want


def test_global_rank_over_many_tasks(spark):
    df = spark.range(5000, numPartitions=9).withColumn("v", F.col("id") % 13)
    got = by_id(ranking.global_rank(df, F.col("v"), F.col("id")), "rank")
    order = sorted(range(5000), key=lambda i: (i % 13, i))
    assert got == {i: n + 1 for n, i in enumerate(order)}


ORDERS = "o_orderkey LONG, o_custkey LONG, o_orderdate DATE, o_totalprice DOUBLE"


def orders(spark, rows):
    return spark.createDataFrame([(i, c, dt.date.fromisoformat(d), p) for i, (c, d, p) in enumerate(rows)], ORDERS)


def test_rfm_windows_and_trends(spark):
    df = orders(spark, [
        (1, "2000-12-31", 30.0), (1, "2000-12-02", 60.0), (1, "2000-12-01", 5.0), (1, "2000-10-03", 1.0),
        (1, "2001-01-01", 100.0), (2, "1999-06-01", 10.0), (3, "2000-03-01", 8.0),
    ])
    rfm = activity.rfm_features(df, "o_custkey", "o_orderdate", "o_totalprice", "2001-01-01")
    rows = {r["o_custkey"]: r for r in rfm.select("*", *[c.alias(n) for n, c in activity.trend_columns().items()]).collect()}
    one = rows[1]
    # the day of the snapshot is outside, 30 days before it is inside
    assert (one["orders_last_30d"], one["orders_last_90d"], one["total_orders"]) == (2, 4, 5)
    assert float(one["spend_last_30d"]) == 90.0 and float(one["lifetime_spend"]) == 196.0
    assert one["days_since_last_purchase"] == 0 and one["avg_order_value_last_90d"] == 24.0
    assert one["spend_trend_30_vs_90"] == pytest.approx(2.813) and one["order_freq_trend_90_vs_365"] == 4.0
    assert (rows[2]["avg_order_value_last_90d"], rows[2]["spend_trend_30_vs_90"], rows[2]["order_freq_trend_90_vs_365"]) == (0.0, None, None)
    assert rows[3]["order_freq_trend_90_vs_365"] == 0.0


def test_purchase_after_the_snapshot_gives_negative_days(spark):
    df = orders(spark, [(1, "2001-02-01", 1.0)])
    rfm = activity.rfm_features(df, "o_custkey", "o_orderdate", "o_totalprice", "2001-01-01")
    assert rfm.first()["days_since_last_purchase"] == -31


def test_churn_label_window(spark):
    df = orders(spark, [(1, "2001-01-01", 1.0), (2, "2001-04-01", 1.0), (3, "2001-03-31", 1.0), (4, "2000-12-31", 1.0)])
    customers = spark.createDataFrame([(i,) for i in range(1, 6)], "c LONG")
    labels = activity.churn_labels(customers, "c", df, "o_custkey", "o_orderdate", "2001-01-01")
    assert {r["c"]: r["churn_label"] for r in labels.collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1}
    assert activity.churn_rate(labels).first()["churn_rate"] == 60.0


def test_order_totals(spark):
    lines = spark.createDataFrame(
        [(1, 2.0, 10.05, 0.1, 5.0), (1, 1.0, 0.99, 0.1, 5.0)], "o LONG, q DOUBLE, p DOUBLE, d DOUBLE, s DOUBLE"
    )
    row = activity.order_totals(lines, "o", "q", "p", "d", "s").first()
    assert [float(row[c]) for c in ("subtotal", "discount_amount", "tax", "total_amount")] == [21.09, 2.11, 2.4, 26.38]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalars.loan_repayment(lit(1200.0), lit(0.0), lit(12)))[0] == 100.0
    assert one(spark, scalars.loan_repayment(lit(1000.0), lit(12.0), lit(12)))[0] == pytest.approx(88.85)
    assert one(spark, scalars.padded_id("CUST", lit(7)), scalars.padded_id("CUST", lit(12345678))) == ("CUST-000007", "CUST-12345678")
    assert one(spark, *[scalars.banded(lit(v)) for v in (49999, 50000, 149999, 150000)]) == ("<50k", "50-100k", "100-150k", ">150k")
    assert one(spark, scalars.direction(lit("Refund")), scalars.direction(lit("Purchase"))) == ("Credit", "Debit")
    assert one(spark, scalars.large_outflow(lit(10000.01), lit("Fee")), scalars.large_outflow(lit(10000.0), lit("Fee"))) == (True, False)
    assert one(spark, *[scalars.quality_label(lit(s)) for s in (0.51, 0.5, 0.25)]) == ("Good", "Fair", "Weak")
    assert one(spark, *[scalars.quality_label(lit(s), "screen") for s in (0.51, 0.5, 0.35, 0.2)]) == ("Excellent", "Good", "Fair", "Weak")
    assert one(spark, scalars.cohesion(lit(0.25)), scalars.as_flag(lit(None).cast("boolean")), scalars.present_flag(lit(None)))[0] == 0.8
    assert one(spark, scalars.churn_propensity(lit(60.0)))[0] == pytest.approx(0.475)
    born, day = lit("2000-01-02").cast("date"), lit("2001-01-01").cast("date")
    assert one(spark, scalars.age_years(born, day), scalars.age_years(lit(None).cast("date"), day)) == (1, None)
    assert float(one(spark, scalars.price_from_margin(lit(10.01), lit(0.35)))[0]) == 13.51


def test_lines_are_grouped_by_tasks_of_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(activity, "TASK_LINES", 10)
    lines = spark.range(300).selectExpr("id % 40 AS l_orderkey", "id % 60 AS l_partkey", "'R' AS l_returnflag", "DATE '2024-01-05' AS l_shipdate")
    orders = spark.range(40).selectExpr("id AS o_orderkey", "IF(id % 7 = 0, NULL, id % 7) AS o_custkey")
    parts = spark.range(50).selectExpr("id AS p_partkey", "concat('t', id % 9) AS p_type", "concat('b', id % 4) AS p_brand")
    assert activity.dealt_lines(lines, orders).rdd.getNumPartitions() == 30
    rows = [(r.o_custkey, r.l_partkey) for r in activity.bought_lines(lines, orders).collect()]
    rollup = {(r.o_custkey, r.l_partkey): r.lines for r in activity.line_rollup(lines, orders, "2024-02-01").collect()}
    assert rollup == {pair: rows.count(pair) for pair in set(rows)}
    want = {c: (len({p % 9 for x, p in rows if x == c and p < 50}), len({p % 4 for x, p in rows if x == c and p < 50})) for c, p in rows if p < 50}
    assert {r[0]: tuple(r[1:]) for r in activity.product_breadth(lines, orders, parts).collect()} == want


def test_own_column_names_and_event_kinds(spark):
    lines = spark.createDataFrame([(1, 7, "back", "2024-01-05"), (1, 8, "ok", "2024-01-05"), (2, 7, "ok", "2022-01-05")], "ord INT, item INT, state STRING, sent STRING")
    orders = spark.createDataFrame([(1, "ann"), (2, "ann")], "id INT, buyer STRING")
    parts = spark.createDataFrame([(7, "shoe", "x"), (8, "hat", "x")], "sku INT, kind STRING, maker STRING")
    names = activity.LineColumns("ord", "item", "state", "sent", "id", "buyer", "sku", "kind", "maker", "back")
    lines = lines.withColumn("sent", F.col("sent").cast("date"))
    found = activity.returns_and_breadth(activity.line_rollup(lines, orders, "2024-02-01", names), parts, names).first()
    assert tuple(found) == ("ann", 3, 1, round(1 / 3, 4), 2, 1)
    assert tuple(activity.returns_rate(lines, orders, "2024-02-01", names).first()) == ("ann", 1, round(1 / 3, 4))
    assert tuple(activity.product_breadth(lines, orders, parts, names).first()) == ("ann", 2, 1)
    events = spark.createDataFrame([("u", "2024-01-30", "crash"), ("u", "2024-01-30", "view")], "u STRING, at STRING, k STRING").withColumn("at", F.col("at").cast("timestamp"))
    row = activity.activity_counts(events, "u", "at", "k", "2024-02-01", (7,), {"crashes": "crash"}).first()
    assert row.asDict() == {"u": "u", "events_7d": 2, "crashes_7d": 1, "days_active_7d": 1}


def test_later_orders_change_only_the_label(spark):
    from tessera.plans.churn_store import churn_features
    from tessera.sources.tables import table

    folder, snapshot = "/root/testdata/sf0.001", "2001-01-01"
    customers, orders, lines, parts = (table(spark, folder, n) for n in ("customer", "orders", "lineitem", "part"))
    earlier = orders.where(F.col("o_orderdate") < F.lit(snapshot).cast("date"))
    whole = {r["customer_id"]: r.asDict() for r in churn_features(customers, orders, lines, parts, snapshot).collect()}
    without = {r["customer_id"]: r.asDict() for r in churn_features(customers, earlier, lines, parts, snapshot).collect()}
    labels = [(r.pop("churn_label"), without[i].pop("churn_label")) for i, r in whole.items()]
    assert whole == without and {b for _, b in labels} == {1} and 0 in {a for a, _ in labels}


def test_order_totals_of_items(spark):
    orders = spark.createDataFrame(
        [(1, [(2, 10.0), (1, 5.555)], "0.10", 3.0), (2, None, "0.00", 1.0), (3, [(None, 1.0)], "0.50", 0.0)],
        "id INT, items ARRAY<STRUCT<n: INT, price: DOUBLE>>, rate STRING, ship DOUBLE",
    )
    rows = {r["id"]: r for r in activity.order_totals_of_items(orders, "items", "n", "price", "rate", "ship").collect()}
    assert [float(rows[1][c]) for c in ("subtotal", "discount_amount", "tax", "total_amount")] == [25.56, 2.56, 2.6, 28.6]
    assert rows[2]["item_count"] == 0 and float(rows[2]["total_amount"]) == 1.1 and float(rows[3]["subtotal"]) == 0.0
