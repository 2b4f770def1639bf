import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(nodes, linked):
    """{node: smallest node reachable} by comparing all with all."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def near(spread, n, seed):
    """Fingerprints around a few centres."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(5)]
    out = set()
    for _ in range(n):
        value = r.choice(centres)
        for _ in range(r.randint(0, spread)):
            value ^= 1 << r.randrange(64)
        out.add(value)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "A b\tc", "a b c d", "The the THE the the É é x", "w " * 500, "ß x \x1c y"])
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("dense", [4, 256])
@pytest.mark.parametrize("way", ["halves", "balls"])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, dense, way):
    """Also when a variant is shared by more fingerprints than are compared pair by pair."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    values = near(6, 120, 3)
    frame = spark.createDataFrame([(signed(x),) for x in values], "bits long")
    found = (simhash.links if way == "halves" else simhash.ball_links)(frame).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4 for r in found)
    pairs = {(r.a, r.b) for r in found} | {(r.b, r.a) for r in found}
    ids = [signed(x) for x in values]
    want = brute_groups(ids, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4)
    assert brute_groups(ids, lambda a, b: (a, b) in pairs) == want


def test_whole_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_groups(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_nulls_repeats_and_clashing_columns(spark, edge_docs):
    docs = edge_docs([None, "", "one two three four five", "one two three four five", "other words stand here now"])
    nameless = docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long"))
    rows = simhash.near_duplicates(docs.union(docs.where("doc_id = 4")).union(nameless)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (4, 4)]
    assert [r.component_id for r in rows if r.doc_id is None] == [2]
    kept = simhash.one_of_each(docs.union(docs.where("doc_id = 4")).union(nameless))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 2, 4]
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(spark, edge_docs):
    docs = edge_docs(["a"]).limit(0)
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0


def test_components_of_chains_and_loops(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)] + [(500, 500), (7, None)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sets = defaultdict(set)
    for a, b in edges:
        if b is not None:
            sets[a].add(b)
            sets[b].add(a)
    assert got == brute_groups(sorted(sets), lambda a, b: b in sets[a])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
