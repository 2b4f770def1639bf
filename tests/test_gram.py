import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import gram, reduction


def vectors(spark, data, parts=4):
    return spark.createDataFrame([(i, row) for i, row in enumerate(data.tolist())], "id INT, v ARRAY<DOUBLE>").repartition(parts)


@pytest.mark.parametrize("center", [None, "mean", "far"])
def test_moments_match_numpy(spark, center):
    data = np.random.default_rng(1).normal(size=(300, 7)) * np.arange(1, 8) + 1e6
    given = {"mean": data.mean(axis=0), "far": np.zeros(7), None: None}[center]
    found = gram.moments(vectors(spark, data), "v", given)
    assert found.n == 300 and found.mean == pytest.approx(data.mean(axis=0), rel=1e-12)
    assert found.covariance(True) == pytest.approx(np.cov(data.T), rel=1e-2 if center == "far" else 1e-9, abs=1 if center == "far" else 1e-9)


def test_five_hundred_columns(spark):
    base = np.random.default_rng(2).normal(size=(400, 3))
    data = base @ np.random.default_rng(3).normal(size=(3, 500)) + 0.01 * np.random.default_rng(4).normal(size=(400, 500))
    found = reduction.fit_vector_components(vectors(spark, data), "v", 3)
    values, axes = np.linalg.eigh(np.cov(data.T))
    assert found.shares == pytest.approx(values[::-1][:3] / values[::-1][:3].sum())
    for loading, axis in zip(found.loadings, axes.T[::-1]):
        assert abs(np.dot(loading, axis)) == pytest.approx(1)
    rows = reduction.vector_covariance(vectors(spark, data), "v")
    assert rows.count() == 250_000
    some = {(r.feature_i, r.feature_j): r.covariance for r in rows.where("feature_i = 17").collect()}
    assert [some[17, j] for j in range(500)] == pytest.approx(np.cov(data.T)[17])


def test_no_rows_and_vectors_that_do_not_fit(spark):
    assert gram.moments(vectors(spark, np.zeros((1, 2))).limit(0), "v").n == 0
    one = gram.moments(vectors(spark, np.ones((1, 2))), "v")
    assert one.n == 1 and (one.scatter == 0).all() and np.isnan(one.covariance(True)).all()
    with pytest.raises(ValueError, match="empty"):
        reduction.fit_vector_components(vectors(spark, np.zeros((1, 2))).limit(0), "v")
    ragged = vectors(spark, np.ones((2, 2))).withColumn("v", F.expr("IF(id = 1, array(1D), v)"))
    with pytest.raises(Exception, match="wide"):
        gram.moments(ragged, "v", [0.0, 0.0])
    with pytest.raises(ValueError, match="more than"):
        gram.moments(ragged, "v", [0.0] * 5000)
