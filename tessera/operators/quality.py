"""How good is a clustering: inertia, cluster statistics, importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions.scalars import cohesion, share_percent, squared_distance
from tessera.functions.sqltext import array_of, name_sql, point_of, text_sql
from tessera.operators.clustering import Centers


def _center_frame(df: DataFrame, given: Centers | DataFrame) -> DataFrame:
    """_id, _center of the k centres of a fit or of a frame of centres, one per label, as `clustering.centers` returns it."""
    if isinstance(given, DataFrame):
        label = next(c for c in given.columns if c not in ("size", "center"))
        return given.select(F.col(name_sql(label)).alias("_id"), F.col("center").alias("_center"))
    rows = F.array(*[F.struct(F.lit(int(i)).alias("_id"), array_of(c).alias("_center")) for i, c in given])
    return df.sparkSession.range(1).select(F.inline(rows))


def with_distance(df: DataFrame, label: str, features: Sequence[str], given: Centers | DataFrame) -> DataFrame:
    """Adds the squared distance of every row to the centre of its label."""
    centers = _center_frame(df, given)
    joined = df.join(centers, df[label] == centers["_id"], "left")
    return joined.withColumn("squared", squared_distance(point_of(features), F.col("_center"))).drop("_id", "_center")


def inertia(df: DataFrame, label: str, features: Sequence[str], given: Centers | DataFrame) -> DataFrame:
    """One row: the total squared distance to the centres."""
    return with_distance(df, label, features, given).agg(F.sum("squared").alias("inertia"))


def cluster_stats(df: DataFrame, label: str, features: Sequence[str], given: Centers | DataFrame, k: int | None = None) -> DataFrame:
    """id, size, centroid, avg_distance for every id below k, empty ones included.

    A cluster without a known centre has a NULL centroid. Without k, the ids
    are those of the centres.
    """
    measured = (
        with_distance(df, label, features, given)
        .groupBy(F.col(label).alias("_label"))
        .agg(F.count("*").alias("_size"), F.avg(F.sqrt("squared")).alias("_avg"))
    )
    centers = _center_frame(df, given)
    ids = centers.select("_id") if k is None else df.sparkSession.range(k).select(F.col("id").alias("_id"))
    ids = ids.select(F.col("_id").cast("int").alias("id"))
    known = ids.join(centers, ids["id"] == centers["_id"], "left")
    return known.join(measured, known["id"] == measured["_label"], "left").select(
        "id",
        F.coalesce("_size", F.lit(0).cast("long")).alias("size"),
        F.col("_center").alias("centroid"),
        F.coalesce("_avg", F.lit(0.0)).alias("avg_distance"),
    )


def feature_importance(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """position, feature, importance, rank: between-cluster sum of squares relative to the largest, the largest first.

    The rows are aggregated once, per label; the rest runs on one row per label
    and feature, and is summed. Equal importances keep the selected order.
    """
    means = ", ".join(
        f"struct({i} AS position, {text_sql(f)} AS feature, avg({name_sql(f)}) AS mean)" for i, f in enumerate(features)
    )
    per_label = df.groupBy(label).agg(F.count("*").alias("n"), F.expr(f"array({means})").alias("means"))
    long = per_label.select("n", F.inline("means"))
    overall = long.groupBy("position").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("overall"))
    gap = F.col("mean") - F.col("overall")
    between = long.join(overall, "position").groupBy("position", "feature").agg(F.sum(F.col("n") * gap * gap).alias("between"))
    # one row per feature from here on
    largest = F.max("between").over(Window.partitionBy())
    scaled = between.select(
        "position",
        "feature",
        (F.col("between") / F.when(largest == 0, F.lit(1.0)).otherwise(largest)).alias("importance"),
    )
    ranked = scaled.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "position")))
    return ranked.orderBy("rank")


def top_features(importance: DataFrame, count: int = fixed.TOP_FEATURES) -> DataFrame:
    """The most important features, ties in the selected order."""
    return importance.where(F.col("rank") <= count).orderBy("rank")


def cluster_context(stats: DataFrame, features: Sequence[str], total: int | Column) -> DataFrame:
    """What a reader needs per cluster: share, named centre values, spread.

    'cohesion' carries the average distance, as the report it feeds expects;
    'compactness' is 1 / (1 + average distance).
    """
    whole = F.lit(total) if isinstance(total, int) else total
    names = F.array(*[F.lit(f) for f in features])
    return stats.select(
        "id",
        "size",
        share_percent(F.col("size"), whole).alias("percent"),
        F.map_from_arrays(names, F.transform("centroid", lambda v: F.round(v, 2))).alias("centroid_values"),
        F.round("avg_distance", 3).alias("cohesion"),
        cohesion(F.col("avg_distance")).alias("compactness"),
    )
