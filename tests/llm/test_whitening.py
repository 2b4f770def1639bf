import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize(("n", "rank"), [(1, 1), (6, 6), (9, 4), (40, 40), (64, 10)])
def test_cholesky_and_jacobi_give_the_eigenvalues(n, rank):
    rng = np.random.default_rng(n)
    half = rng.normal(size=(n, rank)) * np.logspace(0, -5, rank)
    a = half @ half.T
    factor = whitening.pivoted_cholesky(a)
    assert factor.shape == (n, rank) and np.allclose(factor @ factor.T, a, rtol=0, atol=1e-14 * np.trace(a) * n)
    values, vectors = whitening.jacobi(factor)
    # the singular values of the half are the exact ones, to full relative precision of the large ones
    exact = np.linalg.svd(half)[1] ** 2
    assert np.allclose(values, exact, rtol=1e-4, atol=1e-15 * exact[0])
    assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * exact[0])


def test_every_pair_of_columns_meets_once():
    for n in range(9):
        pairs = [tuple(sorted(p)) for i, j in whitening.rounds_of_pairs(n) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def check(spark, rows, components=4):
    out = whitening.whitened(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "2 AS n").repartition(3), components=components).collect()
    kept = [(i, e) for i, e in rows if e and all(v is not None and np.isfinite(v) for v in e)]
    x = np.floor(256 * np.array([e for _, e in kept])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    away = fit - sums / n
    covariance = away.T @ away / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(out) == len(kept) * min(components, x.shape[1])
    found = {}
    for r in out:
        found.setdefault(r.vec_id, []).append(r)
    for (vec_id, _), row in zip(kept, x, strict=True):
        for r in found[vec_id]:
            j = r.component - 1
            assert r.n == n and r.deviation == int(((n * row - sums).astype(object) ** 2).sum())
            assert abs(r.explained - values[j] / values.sum()) <= 1e-9
            want = (row - sums / n) @ vectors[:, j] / np.sqrt(values[j])
            assert abs(abs(r.whitened) - abs(want)) < 1e-7
            assert r.identity_error < 1e-9
    # one sign for all rows of a component
    for j in range(min(components, x.shape[1])):
        white = {r.vec_id: r.whitened for r in out if r.component == j + 1}
        want = {i: (row - sums / n) @ vectors[:, j] / np.sqrt(values[j]) for (i, _), row in zip(kept, x, strict=True)}
        assert abs(abs(sum(white[i] * want[i] for i in want)) - sum(v * v for v in want.values())) < 1e-6 * len(want)


def test_whitened_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, row.tolist()) for i, row in enumerate(rng.normal(size=(300, 10)) * np.arange(1, 11) + 7)]
    check(spark, rows)
    check(spark, rows, 10)
    check(spark, [(i, e[:2]) for i, e in rows])


def test_missing_vectors_go_and_equal_ones_count_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i, row.tolist()) for i, row in enumerate(rng.normal(size=(50, 6)) * np.arange(2, 8))]
    rows += [(100 + i, rows[0][1]) for i in range(200)]
    rows += [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] * 6), (404, [float("inf")] * 6)]
    check(spark, rows)


def test_nothing_to_fit(spark):
    empty = whitening.whitened(spark.createDataFrame([(1, None)], SCHEMA))
    assert empty.collect() == []
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(1, 1, 0, None, 0.0, None)] * 2 + [
        (2, 1, 0, None, 0.0, None)
    ] * 2
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(4)], SCHEMA)).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)}
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))
