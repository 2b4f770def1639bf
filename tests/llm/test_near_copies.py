import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_simhash import brute_groups

from tessera.llm import near_copies


def brute_set(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similar(one, other):
    return len(one & other) / len(one | other) >= 0.8


def copies(seed):
    """Texts with copies of which some words are changed, so that similarities go from 0.7 to 1."""
    r = random.Random(seed)
    out = []
    for size in (60, 100, 160, 250, 400) * 4:
        base = [f"w{r.randrange(5000)}" for _ in range(size)]
        out.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.025, 0.03):
            words = list(base)
            for at in r.sample(range(size), max(1, round(share * size))):
                words[at] = f"x{r.randrange(5000)}"
            out.append(" ".join(words))
    return out


def test_stage_keeps_one_of_each_group_of_near_copies(spark, edge_docs):
    texts = copies(1) + [None, "", " \n", "a b c", "A b  c", "a b c d"]
    sets = [brute_set(x) for x in texts]
    near = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= x < 0.85 for x in near) > 10 and sum(0.7 <= x < 0.8 for x in near) > 10
    want = brute_groups(range(len(texts)), lambda a, b: similar(sets[a], sets[b]))
    docs = edge_docs(texts)
    assert {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs).collect()} == want
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_ball_hashing_alone_finds_the_near_copies_of_close_fingerprints(spark, edge_docs):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[:n] + ["other"] * 3) for n in (400, 399, 398)] + ["no copy " + " ".join(f"v{i}" for i in range(400))]
    docs = edge_docs(texts)
    own = docs.select("doc_id", docs["text"].cast("binary").alias("text"))
    rows = own.mapInArrow(near_copies._classed, "doc_id long, cid binary, size long, bits long, keys array<long>, sketch binary")
    # no two classes share a band
    classes = rows.select(F.col("doc_id").alias("least"), "cid", "size", "bits", F.array("doc_id").alias("keys"), "sketch").localCheckpoint()
    bits = {r.least: r.bits for r in classes.collect()}
    near = {(a, b) for a in bits for b in bits if a < b and ((bits[a] ^ bits[b]) & ((1 << 64) - 1)).bit_count() <= 4}
    assert {(0, 1), (1, 2)} <= near and all(b != 3 for _, b in near)
    roots = classes.join(near_copies._roots(own, classes), "cid").select("least", "root").collect()
    assert {r.least for r in roots} == {0, 1, 2} and len({r.root for r in roots}) == 1


def test_chains_are_followed_past_the_first_of_a_bucket(spark, edge_docs):
    """Each text is near the next only: what isn't near a bucket's first class is compared with the others."""
    words = [f"w{i}" for i in range(700)]
    texts = [" ".join(words[at : at + 100]) for at in range(0, 600, 8)]
    sets = [brute_set(x) for x in texts]
    assert similar(sets[0], sets[1]) and not similar(sets[0], sets[2])
    got = near_copies.near_duplicates(edge_docs(texts)).collect()
    assert {r.component_id for r in got} == {0}


def test_sketches_differ_in_no_more_bits_than_the_sets(spark):
    r = np.random.default_rng(3)
    for size in (1, 50, 70, 130, 4000):
        base = r.integers(0, 1 << 64, size, np.uint64)
        for changed in (0, 1, 3, size // 9, size // 4):
            other = np.unique(np.r_[base[changed:], r.integers(0, 1 << 64, changed, np.uint64)])
            one, its = (np.frombuffer(near_copies.sketch(x), np.uint64) for x in (np.unique(base), other))
            assert int(np.bitwise_count(one ^ its).sum()) <= len(np.setxor1d(base, other))


def test_forest_joins_similar_sets_only_and_leaves_out_failed_pairs():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 64, 1000, np.uint64)
    sets = [np.unique(np.r_[base[5 * i :], r.integers(0, 1 << 64, 5 * i, np.uint64)]) for i in range(8)] + [r.integers(0, 1 << 64, n, np.uint64) for n in (1000, 3, 60)]
    size, sketches, none = np.array(list(map(len, sets))), [near_copies.sketch(x) for x in sets], [set() for _ in sets]
    pairs = near_copies.forest(near_copies.Sketched(size, sketches, none), np.arange(len(sets)))
    assert len(pairs) == 7 and {x for p in pairs for x in p} == set(range(8))
    one_root = near_copies.forest(near_copies.Sketched(size, sketches, none), np.array([0] * 8 + [1, 2, 3]))
    assert one_root == []
    failed = [{*range(8)} - {0}] + [{0} for _ in range(7)] + [set()] * 3
    assert all(0 not in p for p in near_copies.forest(near_copies.Sketched(size, sketches, failed), np.arange(len(sets))))
    near, more = near_copies.closest(near_copies.Sketched(size, sketches, none), np.array([0] * 4 + [1, 1, 2, 2, 3, 4, 5]), 2)
    assert more and {root for x, _ in near for root in [x]} == {4, 5, 6, 7} and len(near) <= 16


@pytest.mark.parametrize("block", [3, 10, 1024])
def test_one_large_group_of_near_copies_proposes_few_pairs(spark, edge_docs, block, monkeypatch):
    """Copies with one to ten changed words, a few of them near no other; buckets are cut into blocks of a few classes."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for n in range(150):
        words = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 3, 4, 10])):
            words[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [brute_set(x) for x in texts]
    want = brute_groups(range(len(texts)), lambda a, b: similar(sets[a], sets[b]))
    assert len(set(want.values())) > 5
    proposed = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, sets: proposed.append(pairs.count()) or verified(pairs, sets))
    assert {x.doc_id: x.component_id for x in near_copies.near_duplicates(edge_docs(texts), block=block).collect()} == want
    assert 1 < len(proposed) < 5 and sum(proposed) < 30 * len(texts) < len(texts) ** 2 / 2


def test_nulls_and_repeats(spark, edge_docs):
    docs = edge_docs([None, "", "one two three four five", "one two three four five", "other words stand here now"])
    nameless = docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long"))
    every = docs.union(docs.where("doc_id = 4")).union(nameless)
    rows = near_copies.near_duplicates(every).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (4, 4)]
    assert [r.component_id for r in rows if r.doc_id is None] == [2]
    kept = near_copies.one_of_each(every)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 2, 4] and kept.where("doc_id is null").count() == 1
