"""The whole segmentation: standardise, reduce, cluster with restarts, score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.operators import quality
from tessera.operators.clustering import Centers, assign
from tessera.operators.features import Scaler, feature_matrix
from tessera.operators.reduction import Components, fit_scaled_components
from tessera.operators.restarts import Fit, best_of, draw_starts, fit_all
from tessera.operators.silhouette import silhouette, silhouette_squared
from tessera.session import shared_folder


@dataclass(frozen=True)
class SegmentResult:
    """Frames are keyed by the caller's row id or by cluster id; models are small values.

    labels: row id, prediction, pc1, pc2. clusters: id, size, centroid,
    avg_distance. importance: position, feature, importance. metrics: one row.
    """

    labels: DataFrame
    clusters: DataFrame
    importance: DataFrame
    metrics: DataFrame
    scaler: Scaler
    components: Components
    runs: tuple[Fit, ...]


def segment(
    df: DataFrame,
    row_id: str,
    features: Sequence[str],
    k: int = fixed.DEFAULT_K,
    seeds: Sequence[int] = fixed.SEEDS,
    measure: str | None = "exact",
    step: float | None = None,
    starts: Callable[[DataFrame], Sequence[Centers]] | None = None,
    rounds: int = fixed.MAX_ROUNDS,
    min_rows: int = fixed.MIN_ROWS,
) -> SegmentResult:
    """Segments rows by k-means on standardised features.

    The restarts share one written and cached copy of the scaled rows and move in
    the same scans, until their labels settle or for so many rounds. They start
    from rows drawn by seed, or from the centres that `starts` makes of the
    scaled rows (row id and features). measure names the silhouette: "exact", whose
    work is quadratic in the distinct points, but for many points of few features,
    "grid" with a step, "squared", which is linear, or None. It is the same at any
    number of rows.
    """
    features = list(features)
    if len(features) < 2:
        raise ValueError("at least 2 features are needed")
    if not fixed.MIN_K <= k <= fixed.MAX_K:
        raise ValueError(f"k must be between {fixed.MIN_K} and {fixed.MAX_K}")
    if measure not in ("exact", "grid", "squared", None) or (measure == "grid") != (step is not None):
        raise ValueError('the measure is "exact", "grid" with a step, "squared" or None')
    spark = df.sparkSession
    shared_folder(spark)
    matrix = feature_matrix(df, features, [row_id]).persist(StorageLevel.MEMORY_AND_DISK)
    if matrix.limit(min_rows).count() < min_rows:
        raise ValueError(f"at least {min_rows} rows are needed")
    scaler, components = fit_scaled_components(matrix, features)
    scaled = scaler.transform(matrix, [row_id]).checkpoint()
    matrix.unpersist()
    points = scaled.persist(StorageLevel.MEMORY_AND_DISK)  # every round reads it
    given_starts = draw_starts(points, row_id, features, k, seeds) if starts is None else starts(points)
    runs = fit_all(points, row_id, features, given_starts, rounds)
    given = best_of(runs).centers
    points.unpersist()
    labelled = assign(scaled, features, given, [row_id, *features]).drop("squared").checkpoint()
    labels = components.transform(labelled, [row_id, "prediction"])
    stats = quality.cluster_stats(labelled, "prediction", features, given, k)
    if measure in ("exact", "grid"):
        # written once: whoever reads two columns of the metrics would have it computed twice
        measures = silhouette(labelled, "prediction", features, step).checkpoint()
    else:
        value = silhouette_squared(labelled, "prediction", features) if measure else None
        measures = labelled.agg(F.lit(value).cast("double").alias("silhouette"), F.count("*").alias("points"))
    shares = F.array(*[F.lit(s) for s in components.shares])
    metrics = measures.select(
        F.col("points").alias("rows"),
        F.lit(k).alias("num_clusters"),
        F.lit(best_of(runs).inertia).alias("inertia"),
        F.col("silhouette"),
        F.lit(measure).cast("string").alias("silhouette_measure"),
        shares.alias("pca_variance_explained"),
    )
    importance = quality.feature_importance(labelled, "prediction", features)
    return SegmentResult(labels, stats, importance, metrics, scaler, components, tuple(runs))


def run_record(
    result: SegmentResult,
    described: DataFrame,
    run_id: str,
    file_name: str,
    created_at: datetime,
    analysis: DataFrame | None = None,
) -> DataFrame:
    """The one row a RunStore keeps of a run: settings, profile, clusters and scores.

    Only rows per cluster and per feature are gathered. Labels of the rows are
    saved apart, with RunStore.save_labels.
    """
    fields = ("id", "name", "size", "centroid", "characteristics", "business_description", "recommended_actions", "metrics")
    clusters = described.agg(F.sort_array(F.collect_list(F.struct(*fields)))).scalar()
    ranked = result.importance.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("rank"), "position", "feature", "importance")))
    ).scalar()
    whole = analysis.select(F.struct("*")).scalar() if analysis is not None else F.lit(None)
    gathered = result.metrics.withColumns({"_clusters": clusters, "_ranked": ranked, "_analysis": whole})
    importance = F.transform("_ranked", lambda r: F.struct(r["feature"].alias("feature"), r["importance"].alias("importance")))
    return gathered.select(
        F.lit(run_id).alias("id"),
        F.lit(file_name).alias("file_name"),
        F.lit(created_at).alias("created_at"),
        F.array(*[F.lit(f) for f in result.scaler.features]).alias("features"),
        "num_clusters",
        F.col("rows").alias("row_count"),
        F.col("_analysis").alias("dataset_metadata"),
        F.struct(
            F.col("_clusters").alias("clusters"),
            "inertia",
            importance.alias("feature_importance"),
            "pca_variance_explained",
        ).alias("clustering_results"),
        F.col("silhouette").alias("silhouette_score"),
    )
