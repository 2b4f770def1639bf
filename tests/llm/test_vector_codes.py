import hashlib

import numpy as np
import pytest

from tessera.llm import gnat, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", range(12))
def test_tree_finds_what_comparing_all_finds(seed):
    rng = np.random.default_rng(seed)
    spread = [3, 50, 4000, 1 << 27][seed % 4]
    entries = rng.integers(-spread, spread, (rng.integers(1, 60), rng.integers(1, 10)))
    points = np.concatenate([rng.integers(-spread, spread, (500, entries.shape[1])), entries])
    squared = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    number, least = gnat.Tree(entries).search(points)
    assert (number == squared.argmin(axis=1)).all() and (least == squared.min(axis=1)).all()


def test_tree_leaves_out_children():
    rng = np.random.default_rng(1)
    middles = rng.integers(-100_000, 100_000, (8, 4))
    entries = np.concatenate([m + rng.integers(-50, 50, (20, 4)) for m in middles])
    tree = gnat.Tree(entries)
    tree.search(entries + 3)
    assert tree.compared < len(entries) ** 2 / 3


def test_roots_are_rounded_to_either_side():
    squared = np.array([0, 1, 2, 3, 4, 8, 9, 10, (1 << 30) ** 2 - 1, (1 << 30) ** 2, (1 << 30) ** 2 + 1])
    assert gnat.root_down(squared).tolist() == [0, 1, 1, 1, 2, 2, 3, 3, (1 << 30) - 1, 1 << 30, 1 << 30]
    assert gnat.root_up(squared).tolist() == [0, 1, 2, 2, 2, 3, 3, 4, 1 << 30, 1 << 30, (1 << 30) + 1]


def brute_force(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((i, e, l) for i, e, l in rows if e and all(v is not None and np.isfinite(v) for v in e)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(4096 * np.array([np.float32(e) for _, e, _ in kept], np.float64)).astype(np.int64)
    x = x.reshape(len(kept), parts, -1)
    ids = list(dict.fromkeys(i for i, _, _ in kept))[:entries]
    first = [next(n for n, r in enumerate(kept) if r[0] == i) for i in ids]
    books = [x[first, part].copy() for part in range(parts)]

    def near(part):
        squared = ((x[:, part, None] - books[part][None]) ** 2).sum(axis=2)
        return squared.argmin(axis=1), squared.min(axis=1)

    for _ in range(rounds):
        for part in range(parts):
            codes = near(part)[0]
            for entry in set(codes.tolist()):
                some = x[codes == entry, part]
                books[part][entry] = some.sum(axis=0) // len(some)
    codes, squared = zip(*map(near, range(parts)), strict=True)
    error = np.sum(squared, axis=0)
    labels = {}
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        labels[label] = labels.get(label, 0) + e
    text = ",".join(str(v) for book in books for v in book.ravel().tolist())
    return sorted(
        ((r[0] is not None, r[0] or 0), c, e, labels[r[2]], text) for r, c, e in zip(kept, np.stack(codes, 1).tolist(), error.tolist(), strict=True)
    )


def result(frame):
    return sorted(((r.vec_id is not None, r.vec_id or 0), r.codes, r.error, r.label_error, r.codebooks) for r in frame.collect())


def table(seed, n, width, ties=False):
    rng = np.random.default_rng(seed)
    values = rng.integers(-2, 3, (n, width)) / 64 if ties else rng.normal(size=(n, width))
    return [(i, [float(np.float32(v)) for v in row], [None, 1, 2][i % 3]) for i, row in enumerate(values)]


@pytest.mark.parametrize(("n", "width", "ties"), [(200, 16, False), (200, 8, True), (5, 24, False), (1, 8, False)])
def test_codes_match_brute_force(spark, n, width, ties):
    rows = table(n, n, width, ties)
    assert result(vector_codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute_force(rows)


def test_missing_vectors_go_and_repeated_rows_stay(spark):
    rows = table(3, 40, 8)
    bad = [(90, None, 1), (91, [], 1), (92, [None] + [0.0] * 7, 1), (93, [float("nan")] * 8, 1), (94, [float("-inf")] * 8, None)]
    rows += [rows[0], rows[0], (None, rows[5][1], None), (1, rows[7][1], 5)]
    frame = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 AS x", "2 AS codes")
    assert result(vector_codes.compressed(frame)) == brute_force(rows)


def test_empty_tables_and_refused_vectors(spark):
    empty = vector_codes.compressed(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "codes", "error", "label_error", "codebooks"]
    for vectors in ([[1.0] * 8, [1.0] * 16], [[1.0] * 9], [[1e9] * 8]):
        with pytest.raises(ValueError):
            vector_codes.compressed(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], SCHEMA)).collect()


def test_decoded_vectors_are_off_by_the_error(spark):
    rows = table(9, 100, 16)
    prepared = vector_codes.prepared(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 4096)
    books = vector_codes.train(prepared)
    coded = {r.vec_id: r for r in vector_codes.encode(prepared, books).collect()}
    assert books.sha256() == hashlib.sha256(books.text().encode()).hexdigest()
    for row in prepared.collect():
        back = vector_codes.decode(books, np.array([coded[row.vec_id].codes]))[0]
        assert ((back - np.array(row.x)) ** 2).sum() == coded[row.vec_id].error
