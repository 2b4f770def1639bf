import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embeddings


def brute(rows):
    """{vec_id: (n_links, component_id)} by all pairs, in double precision."""
    ids = [r[0] for r in rows]
    good = [r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    units = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if g else None for r, g in zip(rows, good, strict=True)]
    near = [
        [j for j in range(len(rows)) if j != i and good[i] and good[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9]
        for i in range(len(rows))
    ]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            least = min([root[i], *(root[j] for j in others)])
            changed |= least != root[i]
            root[i] = least
    smallest = {}
    for i, r in enumerate(root):
        smallest[r] = min(smallest.get(r, ids[i]), ids[i])
    return {ids[i]: (len(near[i]), smallest[root[i]]) for i in range(len(rows))}


def test_given_vectors_against_all_pairs(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors).collect()}
    assert got == want


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_recall_at_the_threshold_and_no_false_link(spark, hashes):
    """Pairs with cosines from 0.9 on, the hardest ones; also with buckets as narrow as large tables have them."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(400, 64))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = np.linspace(0.86, 0.99, 400)[:, None]
    both = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * noise])
    rows = [(i, x.tolist()) for i, x in enumerate(both)]
    want = brute(rows)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), hashes=hashes).collect()
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    found, there = sum(r.n_links for r in got), sum(n for n, _ in want.values())
    assert there > 400 and found / there >= 0.9


def test_crowded_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=32)
    rows = [(i, (centre + 0.1 * rng.normal(size=32)).tolist()) for i in range(150)] + [(200 + i, rng.normal(size=32).tolist()) for i in range(30)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(rows)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0, 0.0], 1, "x"), (1, [2.0, 0.0, 0.0], 1, "x"), (2, [1.0, 0.0, 0.0], 1, "x"), (3, None, 1, "x"), (4, [], 1, "x"), (5, [0.0, 0.0, 0.0], 1, "x"),
        (6, [1.0, None, 0.0], 1, "x"), (7, [nan, 1.0, 0.0], 1, "x"), (8, [inf, 1.0, 0.0], 1, "x"), (9, [1.0, 0.0], 1, "x"), (10, [-1.0, 0.0, 0.0], None, None),
        (11, [1e300, 1e300, 0.0], 1, "x"), (12, [1e-300, 1e-300, 0.0], 1, "x"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, valid string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    assert {i for i, r in got.items() if r[0] == 0} == {3, 4, 5, 6, 7, 8, 9, 10}
    assert all(got[i] == (2, 0, i == 0) for i in (0, 1, 2))
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False)
    again = frame.union(frame.where("vec_id = 10")).union(frame.where("vec_id = 0").withColumn("vec_id", F.lit(None).cast("long")))
    rows = embeddings.near_duplicates(again).collect()
    assert sorted((r.n_links, r.kept) for r in rows if r.vec_id == 10) == [(1, True), (1, True)]
    assert [(r.n_links, r.component_id, r.kept) for r in rows if r.vec_id is None] == [(3, 0, False)]
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("hashes", [1, 2, 3, 4])
@pytest.mark.parametrize("width", [16, 64])
def test_tables_grow_so_that_pairs_at_the_threshold_meet(width, hashes):
    one, other = embeddings.pairs_at(embeddings.THRESHOLD, width, 3000, 99)
    found = np.zeros(len(one), bool)
    for table in range(embeddings.tables_for(width, hashes)):
        found |= embeddings.meet(one, other, table, hashes)
    assert found.mean() >= 0.99


@pytest.mark.parametrize("width, n", [(2, 10**6), (4, 10**6), (16, 10**7), (64, 10**9)])
def test_plans_of_large_tables_reach_the_threshold(width, n):
    assert embeddings.recall(width, *embeddings.plan(width, n)) >= 0.99
