"""Queries on files and on the run history; what they write is derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import number_text
from tessera.functions.scalars import money
from tessera.operators.ranking import global_rank
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources import csv_files, json_files
from tessera.sources.run_store import DuplicateRun, RunStore
from tessera.sources.tables import table

ONE_RUN = "run-1998-07"


@query("""SELECT o_orderpriority || ', "' || o_orderstatus || '"' AS note, count(*) AS orders,
CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day
FROM orders GROUP BY 1""")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "orders-csv")
    note = F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"'))
    csv_files.write_csv(table(spark, sf, "orders").withColumn("note", note), path)
    back = csv_files.read_csv(spark, path)
    return back.groupBy("note").agg(
        F.count("*").alias("orders"),
        F.sum(money(F.col("o_totalprice"))).cast("double").alias("spend"),
        F.date_format(F.max(F.col("o_orderdate").cast("timestamp")), "yyyy-MM-dd").alias("last_day"),
    )


def ragged_orders(orders: DataFrame, path: str) -> None:
    """Order lines of four cells, one with a comma in it; some rows have a cell too few, some one too many."""
    last = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, ",end,more").otherwise(",end")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(","), "o_orderstatus", F.lit(',"'), "o_orderpriority", F.lit(', x"'), last)
    plain = {"header": True, "sep": "\u0001", "quote": "", "escapeQuotes": False}  # lines as they are, under a header in every file
    orders.select(line.alias("key,status,note,last")).write.options(**plain).csv(path)


@query("""SELECT cells, cells = 4 AS kept, count(*) AS n_rows, count(*) FILTER (WHERE record LIKE ',%') AS no_first, min(CASE WHEN cells <> 4 THEN record END) AS example FROM (
SELECT CASE WHEN o_orderkey % 7 = 0 THEN 3 WHEN o_orderkey % 11 = 0 THEN 5 ELSE 4 END AS cells,
CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || ',"' || o_orderpriority || ', x"' ||
CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN ',end,more' ELSE ',end' END AS record FROM orders) GROUP BY 1""")
def csv_rejected(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "orders-ragged")
    ragged_orders(table(spark, sf, "orders"), path)
    return csv_files.csv_cells(spark, path)


def nested_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their address as a struct and their tags as an array; one region has no name."""
    place = F.struct(F.when(F.col("n_regionkey") != 0, F.col("n_name")).alias("nation"), F.struct(F.col("n_regionkey").alias("code")).alias("region"))
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", "c_acctbal", place.alias("address"), F.array("c_mktsegment", "c_name").alias("tags"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS c_acctbal,
CASE WHEN n_regionkey <> 0 THEN n_name ELSE '' END AS address_nation, CAST(n_regionkey AS VARCHAR) AS address_region_code,
'["' || c_mktsegment || '","' || c_name || '"]' AS tags FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def flatten_struct(spark: SparkSession, sf: str) -> DataFrame:
    flat = csv_files.flatten(nested_customers(spark, sf))
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


@query("""SELECT CASE WHEN n_regionkey <> 0 THEN n_name END AS nation, n_regionkey AS region, count(*) AS customers,
CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance, count(DISTINCT c_mktsegment) AS segments
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "customers-json")
    nested = nested_customers(spark, sf)
    json_files.write_json(nested, path)
    back = json_files.read_json(spark, path, nested.schema)
    return back.groupBy(F.col("address.nation").alias("nation"), F.col("address.region.code").alias("region")).agg(
        F.count("*").alias("customers"),
        F.sum(money(F.col("c_acctbal"))).cast("double").alias("balance"),
        F.count_distinct(F.get("tags", F.lit(0))).alias("segments"),
    )


def monthly_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One saved run per order month."""
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.max("o_orderdate").cast("timestamp").alias("created_at"),
        F.sort_array(F.collect_set("o_orderstatus")).alias("features"),
        F.count_distinct("o_orderpriority").cast("int").alias("num_clusters"),
        F.count("*").alias("row_count"),
        F.max("o_totalprice").alias("silhouette_score"),
    ).select(F.concat(F.lit("run-"), "month").alias("id"), F.concat("month", F.lit(".csv")).alias("file_name"), "*").drop("month")


RUNS = """runs AS (SELECT 'run-' || strftime(o_orderdate, '%Y-%m') AS id, strftime(o_orderdate, '%Y-%m') || '.csv' AS file_name,
strftime(max(o_orderdate), '%Y-%m-%d') AS created_at, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS num_clusters,
CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS feature_count, count(*) AS row_count, max(o_totalprice) AS silhouette_score
FROM orders GROUP BY 1, 2)"""
RUN_COLUMNS = "id, file_name, created_at, num_clusters, feature_count, row_count, silhouette_score"


def _saved(spark: SparkSession, sf: str) -> RunStore:
    store = RunStore(spark, scratch_path(spark, "runs"))
    store.append(monthly_runs(spark, sf))
    return store


def _shown(runs: DataFrame) -> DataFrame:
    return runs.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query(f"WITH {RUNS} SELECT {RUN_COLUMNS} FROM runs")
def run_append(spark: SparkSession, sf: str) -> DataFrame:
    store = _saved(spark, sf)
    # known ids are refused, so the second append changes nothing
    try:
        store.append(monthly_runs(spark, sf).withColumn("file_name", F.lit("again.csv")))
    except DuplicateRun:
        return _shown(store.list())
    raise AssertionError("an id was stored twice")


@query(f"WITH {RUNS} SELECT {RUN_COLUMNS}, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS INTEGER) AS place FROM runs ORDER BY created_at DESC")
def run_list(spark: SparkSession, sf: str) -> DataFrame:
    listed = _saved(spark, sf).list()
    ranked = global_rank(listed, F.desc("created_at"), F.col("id"))
    return _shown(ranked.withColumn("place", F.col("rank").cast("int")).drop("rank", "total"))


@query(f"WITH {RUNS} SELECT {RUN_COLUMNS} FROM runs WHERE id = '{ONE_RUN}'")
def run_get(spark: SparkSession, sf: str) -> DataFrame:
    found = _saved(spark, sf).get(ONE_RUN).withColumn("feature_count", F.size("features"))
    return _shown(found).select(*RUN_COLUMNS.split(", "))


@query(f"WITH {RUNS} SELECT {RUN_COLUMNS} FROM runs WHERE id <> '{ONE_RUN}'")
def run_delete(spark: SparkSession, sf: str) -> DataFrame:
    store = _saved(spark, sf)
    store.delete(ONE_RUN)
    return _shown(store.list())


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS row_id, CAST(o_orderkey % 5 AS INTEGER) AS prediction, '{ONE_RUN}' AS id FROM orders""")
def run_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all orders for one run, saved twice: the second ones replace the first; another run's are deleted with it."""
    store = _saved(spark, sf)
    orders = table(spark, sf, "orders")
    store.save_labels(ONE_RUN, orders.select("o_orderkey", F.lit(9).alias("prediction")), "o_orderkey")
    store.save_labels("run-1998-06", orders.select("o_orderkey", F.lit(8).alias("prediction")), "o_orderkey")
    store.save_labels(ONE_RUN, orders.select("o_orderkey", (F.col("o_orderkey") % 5).alias("prediction")), "o_orderkey")
    store.delete("run-1998-06")
    return store.labels(ONE_RUN).union(store.labels("run-1998-06"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_partkey AS VARCHAR) AS text,
  rtrim(rtrim((p_partkey // 1000000) || '.' || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0'), '0'), '.') AS small FROM part""")
def number_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Doubles as plain text, down to millionths."""
    value = F.col("p_partkey").cast("double")
    return table(spark, sf, "part").select("p_partkey", number_text(value).alias("text"), number_text(value / F.lit(1e6)).alias("small"))
