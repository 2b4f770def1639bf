"""Names, descriptions and campaign strategies for segments; result export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions.scalars import cohesion, percent_text, share_percent

INTERPRETATION = (
    "id INT, name STRING, characteristics ARRAY<STRING>, business_description STRING, recommended_actions ARRAY<STRING>"
)
ANSWER = (
    "STRUCT<clusters: ARRAY<STRUCT<id: INT, name: STRING, characteristics: ARRAY<STRING>,"
    " businessDescription: STRING, recommendedActions: ARRAY<STRING>>>, _broken: STRING>"
)


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_per_id(interpretations: DataFrame, order: str) -> DataFrame:
    """The first interpretation of every id; combined before the shuffle, so repeats cost nothing."""
    fields = [c for c in interpretations.columns if c not in ("id", order)]
    return (
        interpretations.groupBy("id").agg(F.min_by(F.struct(*fields), order).alias("_first")).select("id", "_first.*")
    )


def read_answer(spark: SparkSession, answer: str, clusters: DataFrame) -> DataFrame:
    """Interpretations out of the JSON text of an outside adviser.

    Text that is not JSON gives every cluster the plain default texts.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = spark.range(1).select(F.from_json(F.lit(answer), ANSWER, options).alias("a"))
    listed = parsed.select(F.posexplode("a.clusters").alias("position", "c")).select(
        "position",
        "c.id",
        "c.name",
        "c.characteristics",
        F.col("c.businessDescription").alias("business_description"),
        F.col("c.recommendedActions").alias("recommended_actions"),
    )
    broken = parsed.select(F.col("a").isNull() | F.col("a._broken").isNotNull()).scalar()
    plain = clusters.where(broken).select(
        F.lit(0).alias("position"),
        "id",
        F.format_string(fixed.DEFAULT_SEGMENT_NAME, F.col("id") + 1).alias("name"),
        _texts(fixed.DEFAULT_CHARACTERISTICS).alias("characteristics"),
        F.format_string(fixed.UNREADABLE_DESCRIPTION, "size").alias("business_description"),
        _texts(fixed.UNREADABLE_ACTIONS).alias("recommended_actions"),
    )
    return listed.unionByName(plain)


def describe_segments(clusters: DataFrame, interpretations: DataFrame | None = None, order: str = "position") -> DataFrame:
    """Clusters (id, size, avg_distance, ...) with name, texts and metrics.

    Interpretations are matched on id, the first one by `order` wins, and each
    missing field gets its default on its own.
    """
    if interpretations is None:
        interpretations = clusters.sparkSession.createDataFrame([], INTERPRETATION + f", {order} INT")
    found = first_per_id(interpretations, order).withColumnRenamed("id", "_id")
    joined = clusters.join(found, clusters["id"] == found["_id"], "left")
    metrics = F.struct(F.col("avg_distance"), cohesion(F.col("avg_distance")).alias("cohesion"))
    described = {
        "name": F.coalesce("name", F.format_string(fixed.DEFAULT_SEGMENT_NAME, F.col("id") + 1)),
        "characteristics": F.coalesce("characteristics", _texts(fixed.DEFAULT_CHARACTERISTICS)),
        "business_description": F.coalesce("business_description", F.format_string(fixed.DEFAULT_DESCRIPTION, "size")),
        "recommended_actions": F.coalesce("recommended_actions", _texts(fixed.DEFAULT_ACTIONS)),
    }
    kept = [c for c in clusters.columns if c != "avg_distance"]
    return joined.select(*kept, *[e.alias(n) for n, e in described.items()], metrics.alias("metrics"))


def strategies(spark: SparkSession) -> DataFrame:
    schema = "segment STRING, headline STRING, subject_lines ARRAY<STRING>, email_copy STRING, sms_copy STRING"
    return spark.createDataFrame(list(fixed.STRATEGIES), schema)


def strategy_lookup(segments: DataFrame, name: str) -> DataFrame:
    """Every row with the campaign of its segment name; unknown names get the default campaign.

    The name is replaced by the default first, so one join on a five-row table is enough.
    """
    known = [s[0] for s in fixed.STRATEGIES]
    key = F.when(F.col(name).isin(*known), F.col(name)).otherwise(F.lit(fixed.DEFAULT_STRATEGY))
    table = strategies(segments.sparkSession).withColumnRenamed("segment", "_strategy")
    return segments.withColumn("_strategy", key).join(table, "_strategy").drop("_strategy")


def export_results(
    described: DataFrame, importance: DataFrame, features: list[str], silhouette: float | Column
) -> DataFrame:
    """One row with summary, clusters and feature_importance, ready for to_json or write.json.

    Inputs have one row per cluster and per feature.
    """
    score = F.lit(silhouette) if isinstance(silhouette, (int, float)) else silhouette
    totals = (
        described.select(F.struct("id", "name", "size", "business_description", "characteristics", "recommended_actions").alias("c"))
        .agg(F.sum("c.size").alias("total_customers"), F.sort_array(F.collect_list("c")).alias("all"))
    )
    # one row per feature, as a single value
    ranked = importance.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("rank"), "position", "feature", "importance")))
    ).scalar()
    shown = F.transform(
        "all",
        lambda c: F.struct(
            c["name"].alias("name"),
            c["size"].alias("size"),
            percent_text(share_percent(c["size"], F.col("total_customers"))).alias("percentage"),
            c["business_description"].alias("description"),
            c["characteristics"].alias("characteristics"),
            c["recommended_actions"].alias("recommended_actions"),
        ),
    )
    return totals.withColumn("i", ranked).select(
        F.struct(
            "total_customers",
            F.size("all").alias("num_clusters"),
            score.cast("double").alias("silhouette_score"),
            _texts(tuple(features)).alias("features"),
        ).alias("summary"),
        shown.alias("clusters"),
        F.transform("i", lambda x: F.struct(x["feature"].alias("feature"), x["importance"].alias("importance"))).alias(
            "feature_importance"
        ),
    )
