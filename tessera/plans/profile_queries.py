"""Queries on profiling, number reading, feature choice and preview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions import numbers
from tessera.operators import features as feats
from tessera.operators import profile as prof
from tessera.plans.registry import query, r, rounded
from tessera.sources.tables import table

NUMBER, TEXT, TIME = "number", "text", "time"
CUSTOMER = {"c_custkey": NUMBER, "c_name": TEXT, "c_nationkey": NUMBER, "c_acctbal": NUMBER, "c_mktsegment": TEXT}
ORDERS = {
    "o_orderkey": NUMBER, "o_custkey": NUMBER, "o_orderstatus": TEXT, "o_totalprice": NUMBER, "o_orderdate": TIME,
    "o_orderpriority": TEXT,
}
LINEITEM = {
    "l_orderkey": NUMBER, "l_partkey": NUMBER, "l_suppkey": NUMBER, "l_linenumber": NUMBER, "l_quantity": NUMBER,
    "l_extendedprice": NUMBER, "l_discount": NUMBER, "l_tax": NUMBER, "l_returnflag": TEXT, "l_linestatus": TEXT,
    "l_shipdate": TIME,
}
PART = {"p_partkey": NUMBER, "p_name": TEXT, "p_brand": TEXT, "p_type": TEXT, "p_size": NUMBER, "p_retailprice": NUMBER}
EVENTS = {"event_id": NUMBER, "ts": TIME, "user_id": NUMBER, "event_type": TEXT, "value": NUMBER, "props": TEXT}
PROPOSED = ["l_tax", "no_such_column", "l_quantity", "l_returnflag", "l_extendedprice", "l_tax"]


def lenient_sql(text: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract(trim({text}), '{fixed.PREFIX_NUMBER}'), '') AS DOUBLE)"


def _cell_sql(name: str, kind: str) -> tuple[str, str]:
    if kind == NUMBER:
        return f"CAST({name} AS DOUBLE) + 0e0", "CAST(NULL AS VARCHAR)"
    text = name if kind == TEXT else f"strftime({name}, '%Y-%m-%dT%H:%M:%S.%gZ')"
    number = lenient_sql(text)
    return number, f"CASE WHEN {number} IS NULL THEN NULLIF(trim({text}), '') END"


def cells_sql(name: str, columns: dict[str, str], row_id: str) -> str:
    """WITH clauses cells and kinds: every cell, and every column with its counts and class."""
    parts = []
    for position, (column, kind) in enumerate(columns.items()):
        number, text = _cell_sql(column, kind)
        parts.append(
            f"SELECT {position} AS position, '{column}' AS name, {row_id} AS row_id, {number} AS number, {text} AS txt FROM {name}"
        )
    return f"""cells AS ({' UNION ALL '.join(parts)}),
counts AS (
  SELECT position, name,
         count(*) FILTER (WHERE number IS NULL AND txt IS NULL) AS null_count,
         count(DISTINCT coalesce('n' || CAST(number AS VARCHAR), 't' || txt)) AS unique_count,
         count(number) AS numbers, count(coalesce(CAST(number AS VARCHAR), txt)) AS filled,
         min(number) AS mn, max(number) AS mx, avg(number) AS mean, stddev_pop(number) AS sd
  FROM cells GROUP BY position, name),
kinds AS (
  SELECT *, CASE WHEN numbers > 0.9 * filled THEN 'numeric'
                 WHEN unique_count <= 20 AND unique_count < 0.5 * filled THEN 'categorical'
                 ELSE 'text' END AS type FROM counts)"""


def _profile_sql(name: str, columns: dict[str, str], row_id: str) -> str:
    stats = ", ".join(
        f"CASE WHEN type = 'numeric' THEN {r(source, 4)} END AS {alias}"
        for source, alias in (("mn", "min"), ("mx", "max"), ("mean", "mean"), ("sd", "std_dev"))
    )
    return f"""WITH {cells_sql(name, columns, row_id)}
SELECT CAST(position AS INTEGER) AS position, name, type, CAST(null_count AS BIGINT) AS null_count,
       CAST(unique_count AS BIGINT) AS unique_count, {stats} FROM kinds"""


def _flat(profiled: DataFrame) -> DataFrame:
    stats = [rounded(f"stats.{s}", 4).alias(s) for s in ("min", "max", "mean", "std_dev")]
    return profiled.select("position", "name", "type", "null_count", "unique_count", *stats)


@query(_profile_sql("customer", CUSTOMER, "c_custkey"))
def profile_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(prof.profile(table(spark, sf, "customer"), "c_custkey", list(CUSTOMER), samples=False))


@query(_profile_sql("orders", ORDERS, "o_orderkey"))
def profile_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(prof.profile(table(spark, sf, "orders"), "o_orderkey", list(ORDERS), samples=False))


@query(_profile_sql("lineitem", LINEITEM, "l_orderkey"))
def profile_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(prof.profile(table(spark, sf, "lineitem"), "l_orderkey", list(LINEITEM), samples=False))


@query(f"""WITH {cells_sql("orders", ORDERS, "o_orderkey")}
SELECT CAST((SELECT count(*) FROM orders) AS BIGINT) AS row_count, CAST(count(*) AS BIGINT) AS column_count,
       CAST(count(*) FILTER (WHERE type = 'numeric') AS BIGINT) AS numeric_count,
       CAST(count(*) FILTER (WHERE type <> 'numeric') AS BIGINT) AS categorical_count,
       'Dataset with ' || (SELECT count(*) FROM orders) || ' rows and ' || count(*) || ' columns. '
       || count(*) FILTER (WHERE type = 'numeric') || ' numeric features available for clustering.' AS summary
FROM kinds""")
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return prof.profile_summary(table(spark, sf, "orders"), list(ORDERS))


def _samples_sql(name: str, columns: dict[str, str], row_id: str) -> str:
    return f"""WITH {cells_sql(name, columns, row_id)},
seen AS (SELECT position, name, number, txt, min(row_id) AS first_row FROM cells
         WHERE number IS NOT NULL OR txt IS NOT NULL GROUP BY position, name, number, txt),
ranked AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY first_row) AS rank FROM seen)
SELECT name, CAST(rank AS INTEGER) AS rank,
       coalesce(txt, regexp_replace(CAST(number AS VARCHAR), '\\.0$', '')) AS value
FROM ranked WHERE rank <= 5"""


@query(_samples_sql("orders", ORDERS, "o_orderkey"))
def column_samples(spark: SparkSession, sf: str) -> DataFrame:
    profiled = prof.profile(table(spark, sf, "orders"), "o_orderkey", list(ORDERS))
    return profiled.select("name", F.posexplode("sample").alias("rank", "value")).select(
        "name", (F.col("rank") + 1).alias("rank"), "value"
    )


def _types_sql() -> str:
    parts = []
    for name, columns, row_id in (
        ("customer", CUSTOMER, "c_custkey"), ("part", PART, "p_partkey"), ("events", EVENTS, "event_id"),
    ):
        parts.append(f"SELECT * FROM (WITH {cells_sql(name, columns, row_id)} SELECT '{name}' AS table_name, name, type FROM kinds)")
    return " UNION ALL ".join(parts)


@query(_types_sql())
def column_types(spark: SparkSession, sf: str) -> DataFrame:
    frames = []
    for name, columns in (("customer", CUSTOMER), ("part", PART), ("events", EVENTS)):
        profiled = prof.profile(table(spark, sf, name), columns=list(columns), samples=False)
        frames.append(profiled.select(F.lit(name).alias("table_name"), "name", "type"))
    return reduce(DataFrame.unionByName, frames)


@query(f"""WITH {cells_sql("lineitem", LINEITEM, "l_orderkey")}
SELECT CAST(position AS INTEGER) AS position, name, {r('mn', 4)} AS min, {r('mx', 4)} AS max, {r('mean', 4)} AS mean,
       CAST(null_count AS BIGINT) AS null_count, CAST(unique_count AS BIGINT) AS unique_count
FROM kinds WHERE type = 'numeric'""")
def feature_candidates(spark: SparkSession, sf: str) -> DataFrame:
    profiled = prof.profile(table(spark, sf, "lineitem"), columns=list(LINEITEM), samples=False)
    return feats.feature_candidates(profiled).select(
        "position", "name", *[rounded(c, 4).alias(c) for c in ("min", "max", "mean")], "null_count", "unique_count"
    )


@query(f"""WITH {cells_sql("lineitem", LINEITEM, "l_orderkey")},
proposed AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(PROPOSED))}) AS p(rank, name))
SELECT CAST(rank AS INTEGER) AS rank, name FROM proposed
WHERE name IN (SELECT name FROM kinds WHERE type = 'numeric')""")
def feature_recommend_validate(spark: SparkSession, sf: str) -> DataFrame:
    profiled = prof.profile(table(spark, sf, "lineitem"), columns=list(LINEITEM), samples=False)
    return feats.valid_proposals(profiled, PROPOSED)


@query(f"""WITH {cells_sql("lineitem", LINEITEM, "l_orderkey")},
ranked AS (SELECT name, row_number() OVER (ORDER BY position) - 1 AS rank FROM kinds WHERE type = 'numeric')
SELECT 'failed' AS answer, CAST(rank AS INTEGER) AS rank, name, CAST(NULL AS DOUBLE) AS confidence FROM ranked WHERE rank < 4
UNION ALL SELECT 'unreadable', CAST(rank AS INTEGER), name, 0.6 FROM ranked WHERE rank < 3
UNION ALL SELECT 'none_valid', CAST(rank AS INTEGER), name, 0.7 FROM ranked WHERE rank < 6
UNION ALL SELECT 'empty', CAST(rank AS INTEGER), name, 0.7 FROM ranked WHERE rank < 6
UNION ALL SELECT 'null', CAST(rank AS INTEGER), name, 0.7 FROM ranked WHERE rank < 6
UNION ALL SELECT 'valid', CAST(0 AS INTEGER), name, 0.8 FROM ranked WHERE name = 'l_tax'""")
def feature_fallback(spark: SparkSession, sf: str) -> DataFrame:
    profiled = prof.profile(table(spark, sf, "lineitem"), columns=list(LINEITEM), samples=False)
    answers = {
        "failed": None,
        "unreadable": "not json",
        "empty": "",
        "null": "null",
        "none_valid": '{"columns": ["no_such_column"]}',
        "valid": '{"columns": ["no_such_column", "l_tax"]}',
    }
    frames = []
    for name, answer in answers.items():
        chosen = feats.recommend_features(profiled, answer)
        frames.append(
            chosen.select(F.lit(name).alias("answer"), F.posexplode("columns").alias("rank", "name"), "confidence")
        )
    return reduce(DataFrame.unionByName, frames)


@query(f"""SELECT 'priority' AS source, o_orderkey AS id, {lenient_sql('o_orderpriority')} AS number FROM orders
UNION ALL SELECT 'date', o_orderkey, {lenient_sql("strftime(o_orderdate, '%Y-%m-%d')")} FROM orders
UNION ALL SELECT 'customer', c_custkey, {lenient_sql('c_name')} FROM customer""")
def lenient_number(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    from_orders = orders.select(
        F.inline(
            F.array(
                F.struct(F.lit("priority").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text")),
                F.struct(F.lit("date").alias("source"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("text")),
            )
        )
    )
    from_customers = customer.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    return from_orders.unionByName(from_customers).select("source", "id", numbers.lenient_number(F.col("text")).alias("number"))


@query("""SELECT 'region' AS table_name, count(*) >= 10 AS has_min_rows FROM region
UNION ALL SELECT 'nation', count(*) >= 10 FROM nation
UNION ALL SELECT 'customer', count(*) >= 10 FROM customer
UNION ALL SELECT 'orders', count(*) >= 10 FROM orders""")
def min_rows_guard(spark: SparkSession, sf: str) -> DataFrame:
    names = ("region", "nation", "customer", "orders")
    frames = [prof.has_min_rows(table(spark, sf, n)).select(F.lit(n).alias("table_name"), "has_min_rows") for n in names]
    return reduce(DataFrame.unionByName, frames)


@query(f"""SELECT o_orderkey, o_totalprice, coalesce({lenient_sql('o_orderpriority')}, 0e0) AS o_orderpriority,
       coalesce({lenient_sql('o_orderstatus')}, 0e0) AS o_orderstatus FROM orders""")
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return feats.feature_matrix(
        table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority", "o_orderstatus"], ["o_orderkey"]
    )


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       '...' AS more FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5""")
def preview_head(spark: SparkSession, sf: str) -> DataFrame:
    return prof.preview(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
