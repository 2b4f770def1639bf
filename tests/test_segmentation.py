from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import RunStore, analysis, describe_segments, run_record, segment
from tessera.operators import clustering, quality, reduction, silhouette
from tessera.operators.features import fit_scaler

rng = np.random.default_rng(7)
# five groups of five customers, far apart: income, spending score, recency
GROUPS = [(150, 90, 5), (100, 60, 80), (70, 55, 15), (50, 35, 60), (40, 10, 250)]
CUSTOMERS = [
    (g * 5 + i, g, *(float(m + d) for m, d in zip(GROUPS[g], shift)))
    for g in range(5)
    for i, shift in enumerate([(0, 0, 0), (1, 1, 1), (-1, 1, -1), (2, -1, 0), (-2, 0, 2)])
]
FEATURES = ["income", "score", "recency"]


def customers(spark):
    return spark.createDataFrame(CUSTOMERS, "id INT, grp INT, income DOUBLE, score DOUBLE, recency DOUBLE")


def points(spark, data, labels):
    rows = [(int(label), *map(float, row)) for row, label in zip(data, labels)]
    return spark.createDataFrame(rows, "label INT, " + ", ".join(f"f{i} DOUBLE" for i in range(data.shape[1])))


def brute_silhouette(data, labels):
    dist = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    scores = []
    for i, own in enumerate(labels):
        means = {c: dist[i, (labels == c)].sum() / max((labels == c).sum() - (c == own), 1) for c in set(labels)}
        a, b = means[own], min((m for c, m in means.items() if c != own), default=0.0)
        scores.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(scores)


def test_segment_finds_separate_groups(spark):
    result = segment(customers(spark), "id", FEATURES)
    groups = {}
    for row in result.labels.collect():
        groups.setdefault(row["prediction"], set()).add(row["id"] // 5)
    assert sorted(map(tuple, groups.values())) == [(g,) for g in range(5)]
    clusters = result.clusters.collect()
    assert sum(c["size"] for c in clusters) == 25 and len(clusters) == 5
    metrics = result.metrics.first()
    assert metrics["rows"] == 25 and metrics["silhouette"] > 0.8 and metrics["silhouette_measure"] == "exact"
    assert sum(metrics["pca_variance_explained"]) == pytest.approx(1.0)
    assert metrics["inertia"] == min(fit.inertia for fit in result.runs) and len(result.runs) == 5
    assert all(fit.settled for fit in result.runs)
    assert max(r["importance"] for r in result.importance.collect()) == 1.0
    total = quality.inertia(
        result.scaler.transform(customers(spark), ["id"]).join(result.labels.select("id", "prediction"), "id"),
        "prediction", FEATURES, [(c["id"], c["centroid"]) for c in clusters],
    ).first()[0]
    assert total == pytest.approx(metrics["inertia"])


def test_run_is_saved_with_everything(spark, tmp_path):
    result = segment(customers(spark), "id", FEATURES)
    described = describe_segments(result.clusters)
    store = RunStore(spark, str(tmp_path))
    store.append(run_record(result, described, "run-1", "c.csv", datetime(2024, 1, 2), analysis(customers(spark), "id")))
    store.save_labels("run-1", result.labels, "id")
    row = store.get("run-1").first()
    assert (row["num_clusters"], row["row_count"], row["features"]) == (5, 25, FEATURES)
    assert row["dataset_metadata"]["column_count"] == 5 and row["created_at"] == datetime(2024, 1, 2)
    saved = row["clustering_results"]
    assert [c["name"] for c in saved["clusters"]] == [f"Segment {i}" for i in range(1, 6)]
    assert saved["inertia"] == pytest.approx(result.metrics.first()["inertia"]) and saved["feature_importance"][0]["importance"] == 1.0
    assert store.labels("run-1").count() == 25 and store.list().first()["feature_count"] == 3


def test_segment_checks_its_arguments(spark):
    with pytest.raises(ValueError, match="2 features"):
        segment(customers(spark), "id", ["income"])
    with pytest.raises(ValueError, match="k must be"):
        segment(customers(spark), "id", FEATURES, k=11)


def test_more_clusters_than_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 5.0, 5.0)], "id INT, a DOUBLE, b DOUBLE")
    clusters = segment(df, "id", ["a", "b"], k=4, min_rows=1).clusters.collect()
    assert sorted(c["id"] for c in clusters) == [0, 1, 2, 3]
    assert sum(c["size"] for c in clusters) == 3
    assert all(c["avg_distance"] == 0.0 for c in clusters if c["size"] == 0)


def test_nearest_center_prefers_the_lowest_id(spark):
    df = spark.createDataFrame([(1, 0.0)], "id INT, a DOUBLE")
    row = clustering.assign(df, ["a"], [(2, [1.0]), (0, [-1.0]), (1, [1.0])], ["id"]).first()
    assert (row["prediction"], row["squared"]) == (0, 1.0)


def test_unused_center_stays(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "a DOUBLE")
    moved = {r["id"]: r for r in clustering.update(df, ["a"], [(0, [0.0]), (1, [50.0])]).collect()}
    assert moved[0]["center"] == [1.0] and moved[1]["center"] == [50.0] and moved[1]["size"] == 0


@pytest.mark.parametrize("block_rows", [3, 17, 1000])
def test_silhouette_against_brute_force(spark, block_rows):
    data = rng.normal(size=(60, 3)).round(1)
    data = np.vstack([data, data[:20]])
    labels = rng.integers(0, 4, size=80)
    labels[5] = 9
    df = points(spark, data, labels)
    scored = silhouette.silhouette_points(df, "label", ["f0", "f1", "f2"], block_rows=block_rows)
    row = scored.agg(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), F.sum("weight")).first()
    assert row[1] == 80 and row[0] == pytest.approx(brute_silhouette(data, labels), abs=1e-12)


def test_silhouette_with_one_hot_point(spark):
    # a third of all rows are copies of one point: they become one weighted point
    data = np.vstack([rng.normal(size=(40, 2)), np.zeros((20, 2))])
    labels = np.array([0, 1] * 20 + [1] * 20)
    df = points(spark, data, labels)
    assert silhouette.distinct_points(df, "label", ["f0", "f1"]).count() == 41
    assert silhouette.silhouette(df, "label", ["f0", "f1"]).first()[0] == pytest.approx(brute_silhouette(data, labels))


def test_silhouette_on_a_grid_is_that_of_the_snapped_points(spark):
    data, labels = rng.normal(size=(50, 2)), rng.integers(0, 3, size=50)
    snapped = np.round(data / 0.25) * 0.25
    got = silhouette.silhouette(points(spark, data, labels), "label", ["f0", "f1"], step=0.25).first()
    assert got["points"] == 50 and got[0] == pytest.approx(brute_silhouette(snapped, labels))


@pytest.mark.parametrize("block_rows", [None, 30])
def test_silhouette_of_close_points_far_away_and_of_many_labels(spark, block_rows):
    rng = np.random.default_rng(9)
    # next to each other at a million, where a product of coordinates has lost all digits, and one point far off
    data = np.vstack([1e6 + rng.normal(0, 1e-5, (70, 3)), [[-1e6, 0, 0]]])
    labels = np.arange(71) % 40
    got = silhouette.silhouette_points(points(spark, data, labels), "label", ["f0", "f1", "f2"], block_rows=block_rows)
    assert got.agg({"score": "avg"}).first()[0] == pytest.approx(brute_silhouette(data, labels), abs=1e-9)


def test_silhouette_tiles_equal_plain_distances_whatever_the_values():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(128, 5)), rng.normal(size=(300, 5))
    a[3], b[7, 1], b[9, 2] = b[4], np.nan, np.inf
    one, other = (silhouette._Rows(x, np.sort(np.arange(len(x)) % n), np.ones(len(x)), a.mean(axis=0)) for x, n in ((a, 3), (b, 60)))
    with np.errstate(invalid="ignore"):
        got, want = silhouette._distances(one, other), np.sqrt(np.square(a[:, None] - b[None]).sum(axis=2))
    assert got[3, 4] == 0
    np.testing.assert_allclose(got, want, rtol=1e-9)
    np.testing.assert_allclose(other.sums(got)[:, :1], want[:, :5].sum(axis=1, keepdims=True), rtol=1e-9)
    np.testing.assert_allclose(one.sums(got.T)[0], [want[:43, 0].sum(), want[43:86, 0].sum(), want[86:, 0].sum()], rtol=1e-9)


def test_silhouette_of_points_without_numbers_is_0(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.5, 2.0), (1, 9.0, 9.0), (1, None, 9.0), (2, 5.0, 5.0)], "label INT, f0 DOUBLE, f1 DOUBLE")
    assert tuple(silhouette.silhouette(df, "label", ["f0", "f1"]).first()) == (0.0, 5)


def test_silhouette_blocks_are_many_for_the_cores_and_bounded_in_memory():
    assert silhouette.block_count(80, 3, 2, 12) == 1
    for rows, features, labels in ((900_000, 4, 5), (600_000, 64, 10), (100_000, 8, 50_000)):
        blocks = silhouette.block_count(rows, features, labels, 12)
        own = rows / blocks
        assert blocks * (blocks + 1) / 2 >= 12 * 12
        assert 8 * own * features <= silhouette.BLOCK_BYTES and 8 * own * min(labels, own) <= silhouette.BLOCK_BYTES


def test_segment_computes_its_silhouette_once(spark):
    metrics = segment(customers(spark), "id", FEATURES).metrics
    plan = metrics._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "InPandas" not in plan
    assert spark.sparkContext.environment["OPENBLAS_NUM_THREADS"] == "1"


def test_silhouette_of_singletons_and_of_one_cluster(spark):
    data = np.array([[0.0], [4.0]])
    assert silhouette.silhouette(points(spark, data, np.array([0, 1])), "label", ["f0"]).first()[0] == 1.0
    assert silhouette.silhouette(points(spark, data, np.array([0, 0])), "label", ["f0"]).first()[0] == 0.0


def test_the_measure_does_not_depend_on_the_number_of_rows(spark):
    """Copies of all rows change no mean distance but that of a row to its own copies; more blocks change nothing."""
    data, labels = rng.normal(size=(700, 2)), rng.integers(0, 3, size=700)
    once = silhouette.silhouette(points(spark, data, labels), "label", ["f0", "f1"]).first()[0]
    assert once == pytest.approx(brute_silhouette(data, labels), abs=1e-12)
    many = silhouette.silhouette_points(points(spark, data, labels), "label", ["f0", "f1"], block_rows=20)
    assert many.agg(F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).first()[0] == pytest.approx(once, abs=1e-12)


def test_measures_of_a_segmentation(spark):
    df = customers(spark)
    by_name = {m: segment(df, "id", FEATURES, measure=m, step=0.5 if m == "grid" else None).metrics.first() for m in ("exact", "grid", "squared", None)}
    assert by_name["exact"]["silhouette"] > 0.8 and by_name["squared"]["silhouette"] > by_name["exact"]["silhouette"]
    assert by_name[None]["silhouette"] is None and {m: r["silhouette_measure"] for m, r in by_name.items()} == {m: m for m in by_name}
    with pytest.raises(ValueError):
        segment(df, "id", FEATURES, measure="grid")
    with pytest.raises(ValueError):
        segment(df.limit(9), "id", FEATURES)


def test_more_labels_than_a_fit_has(spark):
    data = rng.normal(size=(1300, 1))
    labels = np.arange(1300) // 1
    df = points(spark, data, labels)
    assert silhouette.silhouette(df, "label", ["f0"]).first()[0] == 1.0
    stats = quality.cluster_stats(df, "label", ["f0"], clustering.centers(df, "label", ["f0"]))
    assert stats.count() == 1300 and stats.agg(F.max("avg_distance")).first()[0] == pytest.approx(0.0)



def test_importance(spark):
    data = np.array([[0.0, 1.0, 3.0], [0.0, 2.0, 3.0], [4.0, 1.0, 3.0], [4.0, 2.0, 3.0]])
    rows = quality.feature_importance(points(spark, data, np.array([0, 0, 1, 1])), "label", ["f0", "f1", "f2"])
    assert [tuple(r) for r in quality.top_features(rows, 3).collect()] == [(0, "f0", 1.0, 1), (1, "f1", 0.0, 2), (2, "f2", 0.0, 3)]
    none = quality.feature_importance(points(spark, data[:, 2:], np.array([0, 0, 1, 1])), "label", ["f0"])
    assert none.first()["importance"] == 0.0


def test_components(spark):
    base = rng.normal(size=(200, 1))
    data = np.hstack([base, base + 0.3 * rng.normal(size=(200, 1)), rng.normal(size=(200, 1))])
    names = ["f0", "f1", "f2"]
    df = points(spark, data, np.zeros(200))
    scaled = fit_scaler(df, names).transform(df)
    found = reduction.fit_components(scaled, names)
    matrix = np.array(scaled.select(*names).collect())
    values = np.sort(np.linalg.eigvalsh(np.cov(matrix.T)))[::-1][:2]
    assert found.shares == pytest.approx(tuple(values / values.sum()))
    scores = np.array(found.transform(scaled).collect())
    assert scores.var(axis=0, ddof=1) == pytest.approx(values)
    cells = {(r[0], r[1]): r[2] for r in reduction.covariance_matrix(scaled, names).collect()}
    assert np.array([[cells[a, b] for b in names] for a in names]) == pytest.approx(np.cov(matrix.T))


def test_one_feature_has_one_component(spark):
    df = points(spark, rng.normal(size=(10, 1)), np.zeros(10))
    assert reduction.fit_components(df, ["f0"]).shares == (1.0,)


def test_constant_features_have_no_variance_to_share(spark):
    df = points(spark, np.array([[3.0, 7.0]] * 12), np.zeros(12))
    scaler, found = reduction.fit_scaled_components(df, ["f0", "f1"])
    assert found.shares == (0.0, 0.0) and scaler.stds == (1.0, 1.0)
    assert reduction.fit_components(df, ["f0", "f1"]).shares == (0.0, 0.0)
    with pytest.raises(ValueError):
        reduction.fit_components(df.limit(0), ["f0", "f1"])


def test_scaled_components_are_those_of_the_scaled_rows(spark):
    data = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 3)) + 5
    df = points(spark, data, np.zeros(80))
    names = ["f0", "f1", "f2"]
    scaler, found = reduction.fit_scaled_components(df, names)
    again = reduction.fit_components(scaler.transform(df), names, standardized=True)
    assert np.array(found.loadings) == pytest.approx(np.array(again.loadings)) and found.shares == pytest.approx(again.shares)
