"""Queries on scaling, components, clustering, quality, insights and headline figures."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions import scalars
from tessera.operators import activity, clustering, insights, kpi, quality, reduction, restarts
from tessera.operators import features as feats
from tessera.operators import silhouette as sil
from tessera.plans.registry import RETAIL_SNAPSHOT, query, r, rounded
from tessera.plans.segmentation import segment
from tessera.session import shared_folder
from tessera.sources.tables import table

LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SIZE = 64
VALUE_STEP = 0.5
CUSTOMER_FEATURES = ["order_count", "spend", "average_order", "days_since_last"]


def customer_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Four measures per customer, whole table; a customer without orders has zeros."""
    rfm = activity.rfm_features(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", RETAIL_SNAPSHOT)
    joined = table(spark, sf, "customer").join(rfm, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = F.lit(0.0)
    return joined.select(
        "c_custkey",
        "c_nationkey",
        "c_mktsegment",
        "c_acctbal",
        F.coalesce(F.col("total_orders").cast("double"), zero).alias("order_count"),
        F.coalesce(F.col("lifetime_spend").cast("double"), zero).alias("spend"),
        F.coalesce("average_order_value", zero).alias("average_order"),
        F.coalesce(F.col("days_since_last_purchase").cast("double"), zero).alias("days_since_last"),
    )


CUSTOMER_MEASURES = f"""measures AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal,
         CAST(count(o_orderkey) AS DOUBLE) AS order_count,
         coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 0e0) AS spend,
         CASE WHEN count(o_orderkey) = 0 THEN 0e0 ELSE
           (2 * CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) + count(o_orderkey)) // (2 * count(o_orderkey)) / 100e0 END AS average_order,
         coalesce(CAST(date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '{RETAIL_SNAPSHOT}') AS DOUBLE), 0e0) AS days_since_last
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey
  GROUP BY c_custkey, c_nationkey, c_mktsegment, c_acctbal)"""


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    return feats.expand_vector(table(spark, sf, "embeddings"), "embedding", SIZE, ["vec_id", "label"])


def given_centers(df: DataFrame, label: str, names: list[str]):
    return clustering.center_list(clustering.centers(df, label, names), label)


VECTORS = """points AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cells AS (SELECT vec_id, label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM points),
means AS (SELECT label, dim, avg(x) AS m FROM cells GROUP BY label, dim),
centers AS (SELECT label AS id, list(m ORDER BY dim) AS c FROM means GROUP BY label)"""

SCALED_LINES = ", ".join(
    f"({f} - (SELECT avg({f}) FROM lineitem)) / (SELECT stddev_pop({f}) FROM lineitem) AS z_{f}" for f in LINE_FEATURES
)


@query(f"""WITH scaled AS (SELECT {', '.join(LINE_ID)}, {SCALED_LINES} FROM lineitem)
SELECT {', '.join(LINE_ID)}, {', '.join(r(f'z_{f}', 4) + f' AS {f}' for f in LINE_FEATURES)} FROM scaled""")
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    matrix = feats.feature_matrix(table(spark, sf, "lineitem"), LINE_FEATURES, LINE_ID)
    scaled = feats.fit_scaler(matrix, LINE_FEATURES).transform(matrix, LINE_ID)
    return scaled.select(*LINE_ID, *[rounded(f, 4).alias(f) for f in LINE_FEATURES])


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_i, '{b}' AS feature_j,"
    f" {r(f'covar_samp({a}, {b}) / stddev_pop({a}) / stddev_pop({b})', 6)} AS covariance FROM lineitem"
    for a in LINE_FEATURES for b in LINE_FEATURES
))
def covariance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    matrix = feats.feature_matrix(table(spark, sf, "lineitem"), LINE_FEATURES)
    scaled = feats.fit_scaler(matrix, LINE_FEATURES).transform(matrix)
    return reduction.covariance_matrix(scaled, LINE_FEATURES).withColumn("covariance", rounded("covariance", 6))


@query(f"""SELECT CAST(1 AS INTEGER) AS component, {r('(1 + abs(corr(l_quantity, l_extendedprice))) / 2', 6)} AS share FROM lineitem
UNION ALL SELECT CAST(2 AS INTEGER), {r('(1 - abs(corr(l_quantity, l_extendedprice))) / 2', 6)} FROM lineitem""")
def pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    names = LINE_FEATURES[:2]
    matrix = feats.feature_matrix(table(spark, sf, "lineitem"), names)
    _, found = reduction.fit_scaled_components(matrix, names)
    return found.share_frame(matrix).withColumn("share", rounded("share", 6))


PAIR = ["order_count", "spend"]
SCALED_PAIR = ", ".join(f"({f} - (SELECT avg({f}) FROM measures)) / (SELECT stddev_pop({f}) FROM measures) AS z_{f}" for f in PAIR)


@query(f"""WITH {CUSTOMER_MEASURES}, scaled AS (SELECT c_custkey, {SCALED_PAIR} FROM measures),
s AS (SELECT sign(corr(order_count, spend)) AS s FROM measures)
SELECT c_custkey, {r('abs(z_order_count + s * z_spend) / sqrt(2e0)', 4)} AS pc1,
       {r('abs(z_order_count - s * z_spend) / sqrt(2e0)', 4)} AS pc2 FROM scaled, s""")
def pca_project(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of customers on two related measures; their sign is arbitrary."""
    matrix = feats.feature_matrix(customer_measures(spark, sf), PAIR, ["c_custkey"])
    scaler, found = reduction.fit_scaled_components(matrix, PAIR)
    scores = found.transform(scaler.transform(matrix, ["c_custkey"]), ["c_custkey"])
    return scores.select("c_custkey", rounded(F.abs("pc1"), 4).alias("pc1"), rounded(F.abs("pc2"), 4).alias("pc2"))


def _power_sql(name: str, matrix: str) -> str:
    """The leading eigenvector of a symmetric matrix by power iteration, and its eigenvalue."""
    return f"""{name}_steps(n, v) AS (SELECT 0, CAST([1.0, 0.7, 0.5, 0.3] AS DOUBLE[]) UNION ALL
  SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
  FROM (SELECT n, list_transform(mat, lambda r: list_dot_product(r, v)) AS w FROM {name}_steps, {matrix} WHERE n < 400)),
{name} AS (SELECT v, list_dot_product(v, list_transform(mat, lambda r: list_dot_product(r, v))) AS size FROM {name}_steps, {matrix} WHERE n = 400)"""


CORRELATIONS = ", ".join(
    "[" + ", ".join("1e0" if a == b else f"corr({a}, {b})" for b in CUSTOMER_FEATURES) + "]" for a in CUSTOMER_FEATURES
)


@query(f"""WITH RECURSIVE {CUSTOMER_MEASURES}, m AS (SELECT [{CORRELATIONS}] AS mat FROM measures),
{_power_sql('first', 'm')},
rest AS (SELECT list_transform(mat, lambda r, i: list_transform(r, lambda x, j: x - size * v[i] * v[j])) AS mat FROM m, first),
{_power_sql('second', 'rest')},
found AS (SELECT 1 AS component, first.v AS v, first.size / (first.size + second.size) AS share FROM first, second
UNION ALL SELECT 2, second.v, second.size / (first.size + second.size) FROM first, second)
SELECT CAST(component AS INTEGER) AS component, {r('share', 6)} AS share,
  unnest([{', '.join(f"'{f}'" for f in CUSTOMER_FEATURES)}]) AS feature, {r('abs(unnest(v))', 6)} AS loading FROM found""")
def pca_components(spark: SparkSession, sf: str) -> DataFrame:
    """Loadings of two components; their sign is arbitrary."""
    matrix = feats.feature_matrix(customer_measures(spark, sf), CUSTOMER_FEATURES)
    _, found = reduction.fit_scaled_components(matrix, CUSTOMER_FEATURES)
    names = F.array(*[F.lit(f) for f in CUSTOMER_FEATURES])
    loadings = F.array(*[F.array(*[F.lit(w) for w in loading]) for loading in found.loadings])
    listed = found.share_frame(matrix).select(
        "component", "share", F.explode(F.map_from_arrays(names, F.element_at(loadings, F.col("component")))).alias("feature", "loading")
    )
    return listed.withColumns({"share": rounded("share", 6), "loading": rounded(F.abs("loading"), 6)})


PLACES = """cells AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
pairs AS MATERIALIZED (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS c, covar_pop(a.x, b.x) AS p FROM cells a JOIN cells b USING (vec_id) GROUP BY ALL)"""


@query(f"""WITH {PLACES} SELECT CAST(i AS INTEGER) AS feature_i, CAST(j AS INTEGER) AS feature_j, {r('c', 9)} AS covariance FROM pairs""")
def embedding_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """Covariance of all 64 places of the embeddings, in one scan."""
    found = reduction.vector_covariance(table(spark, sf, "embeddings"), "embedding")
    return found.withColumn("covariance", rounded("covariance", 9))


@query(f"""WITH RECURSIVE {PLACES},
m AS MATERIALIZED (SELECT list(r ORDER BY i) AS mat FROM (SELECT i, list(p ORDER BY j) AS r FROM pairs GROUP BY i)),
steps(n, v) AS (SELECT 0, list_transform(range({SIZE}), lambda x: 1e0 / (x + 1)) UNION ALL
  SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
  FROM (SELECT n, list_transform(mat, lambda r: list_dot_product(r, v)) AS w FROM steps, m WHERE n < 1000)),
found AS (SELECT v, list_dot_product(v, list_transform(mat, lambda r: list_dot_product(r, v))) AS size FROM steps, m WHERE n = 1000)
SELECT CAST(unnest(range({SIZE})) AS INTEGER) AS place, {r('abs(unnest(v))', 4)} AS loading, {r('size', 6)} AS variance FROM found""")
def embedding_components(spark: SparkSession, sf: str) -> DataFrame:
    """The leading component of the embeddings; its sign is arbitrary."""
    points = table(spark, sf, "embeddings")
    found = reduction.fit_vector_components(points, "embedding", 1)
    variance = points.agg(F.var_pop(F.expr(" + ".join(f"embedding[{i}] * {w!r}D" for i, w in enumerate(found.loadings[0])))).alias("variance"))
    listed = F.array(*[F.lit(w) for w in found.loadings[0]])
    return variance.select(F.posexplode(listed).alias("place", "loading"), "variance").select(
        "place", rounded(F.abs("loading"), 4).alias("loading"), rounded("variance", 6).alias("variance")
    )


@query(f"""WITH {VECTORS},
best AS (SELECT vec_id, min(struct_pack(d := list_distance(v, c), id := id)) AS b FROM points, centers GROUP BY vec_id)
SELECT vec_id, CAST(b.id AS INTEGER) AS prediction, {r('b.d', 6)} AS distance FROM best""")
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    points, names = vectors(spark, sf)
    assigned = clustering.assign(points, names, given_centers(points, "label", names), ["vec_id"])
    return assigned.select("vec_id", "prediction", rounded(F.sqrt("squared"), 6).alias("distance"))


@query(f"""WITH {VECTORS},
best AS (SELECT vec_id, min(struct_pack(d := list_distance(v, c), id := id)) AS b FROM points, centers GROUP BY vec_id),
moved AS (SELECT b.id AS id, dim, avg(x) AS m, count(*) AS size FROM best JOIN cells USING (vec_id) GROUP BY b.id, dim)
SELECT CAST(k.label AS INTEGER) AS id, CAST(coalesce(size, 0) AS BIGINT) AS size, CAST(k.dim AS INTEGER) AS dim,
       {r('coalesce(moved.m, k.m)', 6)} AS value
FROM means k LEFT JOIN moved ON moved.id = k.label AND moved.dim = k.dim""")
def kmeans_update(spark: SparkSession, sf: str) -> DataFrame:
    points, names = vectors(spark, sf)
    moved = clustering.update(points, names, given_centers(points, "label", names))
    return moved.select("id", "size", F.posexplode("center").alias("dim", "value")).withColumn("value", rounded("value", 6))


@contextmanager
def fitting_points(spark: SparkSession, sf: str) -> Iterator[DataFrame]:
    """Scaled customers, written once, and cached while models are fitted."""
    points = _written(scaled_customers(spark, sf)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield points
    finally:
        points.unpersist()


def scaled_customers(spark: SparkSession, sf: str) -> DataFrame:
    matrix = feats.feature_matrix(customer_measures(spark, sf), CUSTOMER_FEATURES, ["c_custkey"])
    return feats.fit_scaler(matrix, CUSTOMER_FEATURES).transform(matrix, ["c_custkey"])


SCALED_CUSTOMERS = f"""{CUSTOMER_MEASURES},
scaled AS MATERIALIZED (SELECT c_custkey, [{', '.join(
    f"({f} - (SELECT avg({f}) FROM measures)) / (SELECT stddev_pop({f}) FROM measures)" for f in CUSTOMER_FEATURES
)}] AS v FROM measures)"""


K, SEEDS, DIMS = fixed.DEFAULT_K, fixed.SEEDS, len(CUSTOMER_FEATURES)
NEAREST = "list_position(list_transform(c, lambda x: list_distance(v, x)), list_min(list_transform(c, lambda x: list_distance(v, x))))"

# Starting centres: in every step each customer's weight over -ln of a number from its key's digest, the largest wins.
STARTS = f"""draws(seed, step, c) AS (SELECT unnest({list(SEEDS)}), 0, CAST([] AS DOUBLE[][])
UNION ALL SELECT seed, step + 1, list_append(any_value(c), arg_max(v, {{'race': w / -ln(u), 'u': u, 'v': v}}))
  FROM (SELECT seed, step, c, v, CASE WHEN step = 0 THEN 1e0 ELSE pow(list_min(list_transform(c, lambda x: list_distance(v, x))), 2) END AS w,
    (CAST('0x' || substr(md5(c_custkey || ':' || seed || ':' || step), 1, 13) AS BIGINT) + 0.5e0) / {1 << 52} AS u FROM draws, scaled WHERE step < {K})
  GROUP BY seed, step),
starts AS MATERIALIZED (SELECT seed, c FROM draws WHERE step = {K})"""

# Rounds until no centre moves by more than rounding, for at most as many as the library allows.
FITS = f"""fits(seed, n, c, away) AS (SELECT seed, 0, c, 1e0 FROM starts
UNION ALL SELECT seed, n + 1, list(coalesce(m, old) ORDER BY id), max(coalesce(list_distance(m, old), 0))
  FROM (SELECT seed, n, unnest(range(1, {K + 1})) AS id, unnest(c) AS old FROM fits WHERE away > 1e-9 AND n < {fixed.MAX_ROUNDS}) AS olds
  LEFT JOIN (SELECT seed AS s, near, [{', '.join(f'avg(v[{i + 1}])' for i in range(DIMS))}] AS m
    FROM (SELECT seed, v, {NEAREST} AS near FROM fits, scaled WHERE away > 1e-9 AND n < {fixed.MAX_ROUNDS}) GROUP BY seed, near) AS means
  ON s = seed AND near = id GROUP BY seed, n),
ended AS MATERIALIZED (SELECT seed, arg_max(c, n) AS c FROM fits GROUP BY seed),
placed AS MATERIALIZED (SELECT seed, c_custkey, v, {NEAREST} - 1 AS id, list_min(list_transform(c, lambda x: list_distance(v, x))) AS d FROM ended, scaled),
runs AS MATERIALIZED (SELECT seed, count(*) AS rows, sum(pow(d, 2)) AS inertia FROM placed GROUP BY seed),
best AS MATERIALIZED (SELECT min(seed) AS seed FROM runs WHERE inertia <= (SELECT min(inertia) FROM runs) * (1 + 1e-9))"""
RESTARTS = f"RECURSIVE {SCALED_CUSTOMERS},\n{STARTS},\n{FITS}"


@query(f"""WITH RECURSIVE {SCALED_CUSTOMERS},
{STARTS}, listed AS (SELECT seed, unnest(range({K})) AS id, unnest(c) AS p FROM starts)
SELECT CAST(seed AS INTEGER) AS seed, CAST(id AS INTEGER) AS id, CAST(unnest(range({DIMS})) AS INTEGER) AS dim, {r('unnest(p)', 6)} AS value FROM listed""")
def kmeans_starts(spark: SparkSession, sf: str) -> DataFrame:
    """The customers that five seeds draw as starting centres."""
    with fitting_points(spark, sf) as points:
        starts = restarts.draw_starts(points, "c_custkey", CUSTOMER_FEATURES, K, SEEDS)
    rows = [(seed, i, dim, value) for seed, start in zip(SEEDS, starts) for i, center in start for dim, value in enumerate(center)]
    return spark.createDataFrame(rows, "seed INT, id INT, dim INT, value DOUBLE").withColumn("value", rounded("value", 6))


@query(f"""WITH {RESTARTS},
sizes AS (SELECT id, count(*) AS size FROM placed JOIN best USING (seed) GROUP BY id),
dims AS (SELECT id, unnest(range({DIMS})) AS dim, unnest(p) AS value FROM (SELECT unnest(range({K})) AS id, unnest(c) AS p FROM ended JOIN best USING (seed)))
SELECT CAST(dims.id AS INTEGER) AS id, CAST(coalesce(size, 0) AS BIGINT) AS size, CAST(dim AS INTEGER) AS dim, {r('value', 5)} AS value
FROM dims LEFT JOIN sizes ON sizes.id = dims.id""")
def kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The best of five finished fits: size and place of every cluster."""
    with fitting_points(spark, sf) as points:
        given = restarts.best_of(customer_fits(points)).centers
    labelled = clustering.assign(points, CUSTOMER_FEATURES, given, ["c_custkey", *CUSTOMER_FEATURES])
    stats = quality.cluster_stats(labelled.drop("squared"), "prediction", CUSTOMER_FEATURES, given)
    return stats.select("id", "size", F.posexplode("centroid").alias("dim", "value")).withColumn("value", rounded("value", 5))


@query(f"""WITH {RESTARTS}
SELECT CAST(seed AS INTEGER) AS seed, rows, {r('inertia', 4)} AS inertia, seed = (SELECT seed FROM best) AS is_best FROM runs""")
def kmeans_best_of(spark: SparkSession, sf: str) -> DataFrame:
    """Five seeds, the inertia of each when its labels have settled, the least marked."""
    with fitting_points(spark, sf) as points:
        fits = customer_fits(points)
        best = restarts.best_of(fits)
        rows = points.count()
    listed = [(seed, rows, fit.inertia, fit is best) for seed, fit in zip(SEEDS, fits)]
    return spark.createDataFrame(listed, "seed INT, rows LONG, inertia DOUBLE, is_best BOOLEAN").withColumn("inertia", rounded("inertia", 4))


def customer_fits(points: DataFrame) -> list[restarts.Fit]:
    starts = restarts.draw_starts(points, "c_custkey", CUSTOMER_FEATURES, K, SEEDS)
    return restarts.fit_all(points, "c_custkey", CUSTOMER_FEATURES, starts)


def _written(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


@query(f"""WITH {VECTORS}
SELECT {r('sum(pow(list_distance(v, c), 2))', 6)} AS inertia FROM points JOIN centers ON id = label""")
def inertia(spark: SparkSession, sf: str) -> DataFrame:
    points, names = vectors(spark, sf)
    total = quality.inertia(points, "label", names, clustering.centers(points, "label", names))
    return total.select(rounded("inertia", 6).alias("inertia"))


@query(f"""WITH {VECTORS},
stats AS (SELECT label, count(*) AS size, avg(list_distance(v, c)) AS d FROM points JOIN centers ON id = label GROUP BY label),
ids AS (SELECT unnest(range(12)) AS id)
SELECT CAST(ids.id AS INTEGER) AS id, CAST(coalesce(size, 0) AS BIGINT) AS size, {r('coalesce(d, 0)', 6)} AS avg_distance,
       CAST(means.dim AS INTEGER) AS dim, {r('means.m', 6)} AS value
FROM ids LEFT JOIN stats ON stats.label = ids.id LEFT JOIN means ON means.label = ids.id""")
def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    points, names = vectors(spark, sf)
    stats = quality.cluster_stats(points, "label", names, clustering.centers(points, "label", names), 12)
    return stats.select(
        "id", "size", rounded("avg_distance", 6).alias("avg_distance"), F.posexplode_outer("centroid").alias("dim", "value")
    ).withColumn("value", rounded("value", 6))


IMPORTANCE = f"""{VECTORS},
sizes AS (SELECT label, count(*) AS n FROM points GROUP BY label),
overall AS (SELECT dim, avg(x) AS g FROM cells GROUP BY dim),
between_sum AS (SELECT dim, sum(n * pow(m - g, 2)) AS b FROM means JOIN sizes USING (label) JOIN overall USING (dim) GROUP BY dim),
importance AS (SELECT dim AS position, 'f' || lpad(CAST(dim AS VARCHAR), 2, '0') AS feature,
               b / (SELECT CASE WHEN max(b) = 0 THEN 1 ELSE max(b) END FROM between_sum) AS importance FROM between_sum)"""


@query(f"""WITH {IMPORTANCE}
SELECT CAST(position AS INTEGER) AS position, feature, {r('importance', 6)} AS importance,
       CAST(row_number() OVER (ORDER BY importance.importance DESC, position) AS INTEGER) AS rank FROM importance ORDER BY rank""")
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    points, names = vectors(spark, sf)
    found = quality.feature_importance(points, "label", names)
    return found.withColumn("importance", rounded("importance", 6))


@query(f"""WITH {IMPORTANCE}
SELECT feature, {r('importance', 6)} AS importance FROM importance ORDER BY importance.importance DESC, position LIMIT 5""")
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    points, names = vectors(spark, sf)
    found = quality.top_features(quality.feature_importance(points, "label", names))
    return found.select("feature", rounded("importance", 6).alias("importance"))


def _silhouette_sql(points: str, pair: str, weight: str = "1") -> str:
    """Mean silhouette over a relation pts(id, label, ...) with weights."""
    return f"""{points},
sizes AS (SELECT label, sum({weight}) AS n FROM pts GROUP BY label),
sums AS (SELECT a.id, any_value(a.label) AS label, any_value(a.{weight if weight != '1' else 'one'}) AS w, b.label AS other,
         sum(b.{weight if weight != '1' else 'one'} * {pair}) AS s
         FROM pts a, pts b GROUP BY a.id, b.label),
ab AS (SELECT sums.id, any_value(w) AS w,
       sum(CASE WHEN other = sums.label THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a,
       coalesce(min(CASE WHEN other <> sums.label THEN s / n END), 0) AS b
       FROM sums JOIN sizes ON sizes.label = other GROUP BY sums.id),
scores AS (SELECT w, CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS score FROM ab)"""


EXACT = _silhouette_sql(
    "pts AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v, 1 AS one FROM embeddings)",
    "list_distance(a.v, b.v)", "one",
)


@query(f"WITH {EXACT} SELECT {r('sum(w * score) / sum(w)', 6)} AS silhouette, CAST(sum(w) AS BIGINT) AS points FROM scores")
def silhouette_exact(spark: SparkSession, sf: str) -> DataFrame:
    points, names = vectors(spark, sf)
    return sil.silhouette(points, "label", names).withColumn("silhouette", rounded("silhouette", 6))


GRID = _silhouette_sql(
    f"""{CUSTOMER_MEASURES},
scaled AS (SELECT c_mktsegment AS label,
  (spend - (SELECT avg(spend) FROM measures)) / (SELECT stddev_pop(spend) FROM measures) AS x,
  (days_since_last - (SELECT avg(days_since_last) FROM measures)) / (SELECT stddev_pop(days_since_last) FROM measures) AS y
  FROM measures),
snapped AS (SELECT label, round(x / {VALUE_STEP}e0) * {VALUE_STEP}e0 + 0e0 AS x, round(y / {VALUE_STEP}e0) * {VALUE_STEP}e0 + 0e0 AS y FROM scaled),
pts AS (SELECT row_number() OVER () AS id, label, x, y, count(*) AS weight FROM snapped GROUP BY label, x, y)""",
    "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))", "weight",
)


@query(f"WITH {GRID} SELECT {r('sum(w * score) / sum(w)', 6)} AS silhouette, CAST(sum(w) AS BIGINT) AS points FROM scores")
def silhouette_grid(spark: SparkSession, sf: str) -> DataFrame:
    names = ["spend", "days_since_last"]
    matrix = feats.feature_matrix(customer_measures(spark, sf), names, ["c_mktsegment"])
    scaled = feats.fit_scaler(matrix, names).transform(matrix, ["c_mktsegment"])
    return sil.silhouette(scaled, "c_mktsegment", names, VALUE_STEP).withColumn("silhouette", rounded("silhouette", 6))


@query(f"""WITH pts AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sizes AS (SELECT label, count(*) AS n FROM pts GROUP BY label),
sums AS (SELECT a.id, any_value(a.label) AS label, b.label AS other, sum(pow(list_distance(a.v, b.v), 2)) AS s FROM pts a, pts b GROUP BY a.id, b.label),
ab AS (SELECT sums.id, max(CASE WHEN other = sums.label THEN n END) AS n,
       sum(CASE WHEN other = sums.label THEN CASE WHEN n > 1 THEN s / (n - 1) END END) AS a,
       min(CASE WHEN other <> sums.label THEN s / n END) AS b
       FROM sums JOIN sizes ON sizes.label = other GROUP BY sums.id)
SELECT {r('avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)', 6)} AS silhouette, count(*) AS points FROM ab""")
def silhouette_squared(spark: SparkSession, sf: str) -> DataFrame:
    points, names = vectors(spark, sf)
    score = sil.silhouette_squared(points, "label", names)
    return points.agg(rounded(F.lit(score), 6).alias("silhouette"), F.count("*").alias("points"))


@query(f"""WITH {VECTORS},
stats AS (SELECT label, count(*) AS size, avg(list_distance(v, c)) AS d FROM points JOIN centers ON id = label GROUP BY label)
SELECT CAST(label AS INTEGER) AS id, size, {r('100.0 * size / (SELECT count(*) FROM points)', 1)} AS percent,
       'f' || lpad(CAST(dim AS VARCHAR), 2, '0') AS feature, {r('m', 2)} AS value, {r('d', 3)} AS cohesion,
       {r('1 / (1 + d)', 6)} AS compactness
FROM stats JOIN means USING (label)""")
def cluster_context(spark: SparkSession, sf: str) -> DataFrame:
    points, names = vectors(spark, sf)
    stats = quality.cluster_stats(points, "label", names, clustering.centers(points, "label", names))
    total = points.agg(F.count("*")).scalar()
    context = quality.cluster_context(stats, names, total)
    return context.select(
        "id", "size", rounded("percent", 1).alias("percent"), F.explode("centroid_values").alias("feature", "value"),
        rounded("cohesion", 3).alias("cohesion"), rounded("compactness", 6).alias("compactness"),
    ).withColumn("value", rounded("value", 2))


def nation_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of one nation as a cluster, measured on the standardised balance."""
    matrix = feats.feature_matrix(table(spark, sf, "customer"), ["c_acctbal"], ["c_nationkey"])
    scaled = feats.fit_scaler(matrix, ["c_acctbal"]).transform(matrix, ["c_nationkey"])
    return quality.cluster_stats(scaled, "c_nationkey", ["c_acctbal"], clustering.centers(scaled, "c_nationkey", ["c_acctbal"]), 25)


NATION_CLUSTERS = """scaled AS (SELECT c_nationkey AS id, (c_acctbal - (SELECT avg(c_acctbal) FROM customer))
  / (SELECT stddev_pop(c_acctbal) FROM customer) AS z FROM customer),
mids AS (SELECT id, avg(z) AS m FROM scaled GROUP BY id),
raw AS (SELECT ids.id, count(scaled.id) AS size, coalesce(avg(abs(z - m)), 0) AS d
  FROM (SELECT unnest(range(25)) AS id) ids LEFT JOIN scaled ON scaled.id = ids.id LEFT JOIN mids ON mids.id = ids.id GROUP BY ids.id)"""


@query(f"""WITH {NATION_CLUSTERS},
notes AS (SELECT CASE WHEN n_regionkey = 4 THEN n_nationkey + 100 ELSE n_nationkey END AS id, CASE WHEN n_regionkey <> 1 THEN 'Market ' || n_name END AS name,
                 CASE WHEN n_regionkey <> 2 THEN 'in region ' || n_regionkey END AS trait,
                 CASE WHEN n_regionkey <> 3 THEN 'Customers of ' || n_name END AS text FROM nation)
SELECT CAST(raw.id AS INTEGER) AS id, coalesce(name, 'Segment ' || (raw.id + 1)) AS name, CAST(size AS BIGINT) AS size,
       coalesce(trait, 'Customer segment identified') AS characteristics,
       coalesce(text, 'A segment of ' || size || ' customers with distinct behavioral patterns.') AS business_description,
       'Analyze segment|Develop campaigns' AS recommended_actions, {r('d', 6)} AS avg_distance, {r('1 / (1 + d)', 6)} AS cohesion
FROM raw LEFT JOIN notes ON notes.id = raw.id""")
def cluster_insights_merge(spark: SparkSession, sf: str) -> DataFrame:
    # notes on region 4 carry ids that no cluster has
    unknown = F.when(F.col("n_regionkey") == 4, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey"))
    notes = table(spark, sf, "nation").select(
        unknown.alias("id"),
        F.lit(0).alias("position"),
        F.when(F.col("n_regionkey") != 1, F.concat(F.lit("Market "), "n_name")).alias("name"),
        F.when(F.col("n_regionkey") != 2, F.array(F.concat(F.lit("in region "), F.col("n_regionkey").cast("string")))).alias("characteristics"),
        F.when(F.col("n_regionkey") != 3, F.concat(F.lit("Customers of "), "n_name")).alias("business_description"),
        F.lit(None).cast("array<string>").alias("recommended_actions"),
    )
    later = notes.withColumn("position", F.lit(1)).withColumn("name", F.lit("a later note"))
    described = insights.describe_segments(nation_clusters(spark, sf), later.unionByName(notes))
    return described.select(
        "id", "name", "size", F.array_join("characteristics", "|").alias("characteristics"), "business_description",
        F.array_join("recommended_actions", "|").alias("recommended_actions"),
        rounded("metrics.avg_distance", 6).alias("avg_distance"), rounded("metrics.cohesion", 6).alias("cohesion"),
    )


ANSWERS = {
    "readable": '{"clusters": [{"id": 0, "name": "Zero", "characteristics": ["a", "b"], "businessDescription": "First of all",'
    ' "recommendedActions": ["Call"]}, {"id": 1, "name": "One", "characteristics": [], "businessDescription": "Next", "recommendedActions": ["Write", "Wait"]}]}',
    "partial": '{"clusters": [{"id": 2, "name": "Two"}]}',
    "unreadable": "no JSON at all",
}
PLAIN_TEXT = "'A segment of ' || size || ' customers with distinct behavioral patterns.'"


@query(f"""WITH {NATION_CLUSTERS}, kinds AS (SELECT * FROM (VALUES ('readable'), ('partial'), ('unreadable')) AS k(answer))
SELECT answer, CAST(id AS INTEGER) AS id,
  CASE WHEN answer = 'readable' AND id = 0 THEN 'Zero' WHEN answer = 'readable' AND id = 1 THEN 'One' WHEN answer = 'partial' AND id = 2 THEN 'Two'
       ELSE 'Segment ' || (id + 1) END AS name,
  CAST(size AS BIGINT) AS size,
  CASE WHEN answer = 'readable' AND id = 0 THEN 'a|b' WHEN answer = 'readable' AND id = 1 THEN '' ELSE 'Customer segment identified' END AS characteristics,
  CASE WHEN answer = 'readable' AND id = 0 THEN 'First of all' WHEN answer = 'readable' AND id = 1 THEN 'Next'
       WHEN answer = 'unreadable' THEN 'A segment of ' || size || ' customers' ELSE {PLAIN_TEXT} END AS business_description,
  CASE WHEN answer = 'readable' AND id = 0 THEN 'Call' WHEN answer = 'readable' AND id = 1 THEN 'Write|Wait'
       WHEN answer = 'unreadable' THEN 'Analyze further' ELSE 'Analyze segment|Develop campaigns' END AS recommended_actions
FROM raw, kinds""")
def insights_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by nation, described by an adviser's text that is readable, names one cluster only, or isn't JSON."""
    clusters = nation_clusters(spark, sf)
    frames = []
    for kind, answer in ANSWERS.items():
        described = insights.describe_segments(clusters, insights.read_answer(spark, answer, clusters))
        frames.append(
            described.select(
                F.lit(kind).alias("answer"), "id", "name", "size", F.array_join("characteristics", "|").alias("characteristics"),
                "business_description", F.array_join("recommended_actions", "|").alias("recommended_actions"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


@query(f"""WITH {EXACT},
n AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
t AS (SELECT count(*) AS total FROM embeddings),
s AS (SELECT sum(w * score) / sum(w) AS silhouette FROM scores)
SELECT total AS total_customers, CAST(10 AS INTEGER) AS num_clusters, {r('silhouette', 6)} AS silhouette_score,
       'Segment ' || (label + 1) AS name, size, printf('%.1f%%', round(100.0 * size / total, 1)) AS percentage,
       'A segment of ' || size || ' customers with distinct behavioral patterns.' AS description,
       'Customer segment identified' AS characteristics, 'Analyze segment|Develop campaigns' AS recommended_actions,
       CAST(64 AS INTEGER) AS importance_rows
FROM n, t, s""")
def result_export(spark: SparkSession, sf: str) -> DataFrame:
    points, names = vectors(spark, sf)
    stats = quality.cluster_stats(points, "label", names, clustering.centers(points, "label", names))
    score = sil.silhouette(points, "label", names).select("silhouette").scalar()
    exported = insights.export_results(
        insights.describe_segments(stats), quality.feature_importance(points, "label", names), names, score
    )
    as_text = exported.select(F.to_json(F.struct("summary", "clusters", "feature_importance")).alias("json"))
    back = as_text.select(F.from_json("json", exported.schema).alias("r"))
    return back.select(
        "r.summary.total_customers", "r.summary.num_clusters",
        rounded("r.summary.silhouette_score", 6).alias("silhouette_score"),
        F.size("r.feature_importance").alias("importance_rows"), F.explode("r.clusters").alias("c"),
    ).select(
        "total_customers", "num_clusters", "silhouette_score", "c.name", "c.size", "c.percentage", "c.description",
        F.array_join("c.characteristics", "|").alias("characteristics"),
        F.array_join("c.recommended_actions", "|").alias("recommended_actions"), "importance_rows",
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STRATEGY_ROWS = ", ".join(
    f"({_text(s[0])}, {_text(s[1])}, {_text(' | '.join(s[2]))}, {_text(s[3])}, {_text(s[4])})" for s in fixed.STRATEGIES
)
SEGMENT_NAMES = {
    "AUTOMOBILE": "High-Value Loyalists", "BUILDING": "At-Risk Champions", "FURNITURE": "Casual Browsers",
    "HOUSEHOLD": "Dormant Users",
}


@query(f"""WITH strategy AS (SELECT * FROM (VALUES {STRATEGY_ROWS}) AS s(segment, headline, subject_lines, email_copy, sms_copy)),
named AS (SELECT c_custkey, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_NAMES.items())}
          ELSE c_mktsegment END AS segment FROM customer)
SELECT c_custkey, named.segment, s.headline, s.subject_lines, s.email_copy, s.sms_copy FROM named
JOIN strategy s ON s.segment = CASE WHEN named.segment IN (SELECT segment FROM strategy) THEN named.segment ELSE 'New Potential' END""")
def strategy_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(part) for pair in SEGMENT_NAMES.items() for part in pair])
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.coalesce(F.try_element_at(names, F.col("c_mktsegment")), F.col("c_mktsegment")).alias("segment")
    )
    found = insights.strategy_lookup(customers, "segment")
    return found.withColumn("subject_lines", F.array_join("subject_lines", " | "))


def _quality_sql(steps, lowest: str) -> str:
    return "CASE " + " ".join(f"WHEN score > {bound} THEN '{name}'" for bound, name in steps) + f" ELSE '{lowest}' END"


@query(f"""WITH scored AS (SELECT c_custkey, c_acctbal / 10000e0 AS score FROM customer),
labelled AS (SELECT *, {_quality_sql(fixed.REPORT_QUALITY, fixed.LOWEST_QUALITY)} AS report_quality,
             {_quality_sql(fixed.SCREEN_QUALITY, fixed.LOWEST_QUALITY)} AS screen_quality FROM scored)
SELECT c_custkey, report_quality, screen_quality,
       CASE screen_quality {' '.join(f"WHEN '{k}' THEN {_text(v)}" for k, v in fixed.QUALITY_ADVICE.items())} END AS advice FROM labelled""")
def quality_label(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("c_acctbal") / F.lit(10000.0)
    return table(spark, sf, "customer").select(
        "c_custkey",
        scalars.quality_label(score, "report").alias("report_quality"),
        scalars.quality_label(score, "screen").alias("screen_quality"),
        scalars.quality_advice(score).alias("advice"),
    )


SEGMENTS = f"""{CUSTOMER_MEASURES},
active AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '{RETAIL_SNAPSHOT}' AND o_orderdate < DATE '{RETAIL_SNAPSHOT}' + 90),
segments AS (SELECT c_mktsegment, count(*) AS customers, avg(spend) AS avg_ltv, avg(CASE WHEN o_custkey IS NULL THEN 1e0 ELSE 0e0 END) AS churned
             FROM measures LEFT JOIN active ON c_custkey = o_custkey GROUP BY c_mktsegment),
risky AS (SELECT *, CASE WHEN churned < 1e0 / 3 THEN 'low' WHEN churned < 2e0 / 3 THEN 'medium' ELSE 'high' END AS churn_risk FROM segments)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    labels = activity.churn_labels(customers, "c_custkey", orders, "o_custkey", "o_orderdate", RETAIL_SNAPSHOT)
    joined = customer_measures(spark, sf).join(labels, "c_custkey")
    return kpi.segment_table(joined, "c_mktsegment", "spend", "churn_label")


@query(f"WITH {SEGMENTS} SELECT c_mktsegment, customers, {r('avg_ltv', 2)} AS avg_ltv, churn_risk FROM risky")
def segment_table(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).withColumn("avg_ltv", rounded("avg_ltv", 2))


@query(f"""WITH {SEGMENTS} SELECT CAST(sum(customers) AS BIGINT) AS total_customers, count(*) AS active_segments, {r('avg(avg_ltv)', 2)} AS avg_ltv,
CAST(sum(CASE WHEN churn_risk = 'high' THEN customers ELSE 0 END) AS BIGINT) AS high_risk_customers FROM risky""")
def segment_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.segment_kpis(_segments(spark, sf)).withColumn("avg_ltv", rounded("avg_ltv", 2))


@query(f"WITH {CUSTOMER_MEASURES} SELECT c_custkey AS id, c_acctbal AS x, spend AS y, c_mktsegment AS cluster FROM measures")
def segment_scatter(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.scatter_frame(customer_measures(spark, sf), "c_custkey", "c_acctbal", "spend", "c_mktsegment")


FLAGSHIP = _silhouette_sql(
    f"{RESTARTS},\nmine AS MATERIALIZED (SELECT c_custkey, v, id, d FROM placed JOIN best USING (seed)),\n"
    "pts AS (SELECT c_custkey AS id, mine.id AS label, v, 1 AS one FROM mine)", "list_distance(a.v, b.v)", "one"
)


@query(f"""WITH {FLAGSHIP},
ids AS (SELECT unnest(range({K})) AS id),
stats AS (SELECT id, count(*) AS size, avg(d) AS d FROM mine GROUP BY id),
s AS (SELECT sum(w * score) / sum(w) AS silhouette FROM scores)
SELECT CAST(ids.id AS INTEGER) AS id, 'Segment ' || (ids.id + 1) AS name, CAST(coalesce(size, 0) AS BIGINT) AS size,
       {r('100.0 * coalesce(size, 0) / (SELECT count(*) FROM customer)', 1)} AS percent, {r('coalesce(d, 0)', 5)} AS avg_distance,
       {r('1 / (1 + coalesce(d, 0))', 5)} AS cohesion, {r('silhouette', 5)} AS silhouette
FROM ids LEFT JOIN stats ON stats.id = ids.id, s""")
def segment_customers(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: customers segmented on four measures, the best of five finished fits, one row per segment."""
    result = segment(customer_measures(spark, sf), "c_custkey", CUSTOMER_FEATURES)
    described = insights.describe_segments(result.clusters)
    rows = result.metrics.select("rows").scalar()
    silhouette = result.metrics.select("silhouette").scalar()
    return described.select(
        "id", "name", "size",
        rounded(scalars.share_percent(F.col("size"), rows), 1).alias("percent"),
        rounded("metrics.avg_distance", 5).alias("avg_distance"),
        rounded("metrics.cohesion", 5).alias("cohesion"),
        rounded(silhouette, 5).alias("silhouette"),
    )


@query("""SELECT count(*) AS rows, CAST(5 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced_rows, CAST(0 AS BIGINT) AS moved_centers,
true AS inertia_agrees FROM customer""")
def kmeans_converged(spark: SparkSession, sf: str) -> DataFrame:
    """A finished fit: every row at its nearest centre, every centre the mean of its rows, inertia as reported."""
    with fitting_points(spark, sf) as scaled:
        points = clustering.vectorized(scaled, CUSTOMER_FEATURES, ["c_custkey"])
        model = clustering.fit_kmeans(points, fixed.DEFAULT_K, fixed.SEEDS[0])
    given = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    rows = model.transform(points).select(vector_to_array("vector").alias("v"), "prediction")
    rows = rows.select("prediction", *[F.get("v", F.lit(i)).alias(f) for i, f in enumerate(CUSTOMER_FEATURES)])
    nearest = clustering.assign(rows.withColumnRenamed("prediction", "label"), CUSTOMER_FEATURES, given, ["label"])
    placed = nearest.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("label") != F.col("prediction")).alias("misplaced_rows"),
        (F.abs(F.sum("squared") - model.summary.trainingCost) < 1e-6 * model.summary.trainingCost).alias("inertia_agrees"),
    )
    moved = quality.with_distance(
        clustering.centers(rows, "prediction", CUSTOMER_FEATURES).select(
            "prediction", *[F.get("center", F.lit(i)).alias(f) for i, f in enumerate(CUSTOMER_FEATURES)]
        ),
        "prediction", CUSTOMER_FEATURES, given,
    )
    return placed.select(
        "rows",
        moved.agg(F.count("*")).scalar().alias("clusters"),
        "misplaced_rows",
        moved.agg(F.count_if(F.col("squared") > 1e-12)).scalar().alias("moved_centers"),
        "inertia_agrees",
    )


@query("""SELECT count(*) AS rows, CAST(5 AS BIGINT) AS clusters, count(*) AS labelled, true AS shares_add_up, true AS importance_scaled,
true AS silhouette_in_range, true AS inertia_agrees FROM customer""")
def segment_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold for any segmentation, whatever the random start."""
    result = segment(customer_measures(spark, sf), "c_custkey", CUSTOMER_FEATURES)
    shares = F.aggregate("pca_variance_explained", F.lit(0.0), lambda a, b: a + b)
    # inertia once more, from the labels alone: every row against the mean of its cluster
    matrix = feats.feature_matrix(customer_measures(spark, sf), CUSTOMER_FEATURES, ["c_custkey"])
    scaled = result.scaler.transform(matrix, ["c_custkey"]).join(result.labels.select("c_custkey", "prediction"), "c_custkey")
    again = quality.inertia(scaled, "prediction", CUSTOMER_FEATURES, clustering.centers(scaled, "prediction", CUSTOMER_FEATURES)).scalar()
    return result.metrics.select(
        F.col("rows"),
        result.clusters.agg(F.count_if(F.col("size") > 0)).scalar().alias("clusters"),
        result.labels.agg(F.count_distinct("c_custkey")).scalar().alias("labelled"),
        (F.abs(shares - 1) < 1e-9).alias("shares_add_up"),
        result.importance.agg((F.max("importance") == 1) & (F.min("importance") >= 0)).scalar().alias("importance_scaled"),
        F.col("silhouette").between(-1, 1).alias("silhouette_in_range"),
        (F.abs(F.col("inertia") - again) <= 1e-6 * again).alias("inertia_agrees"),
    )
