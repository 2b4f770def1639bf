import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.words import Ranges, split

SCHEMA = "doc_id long, text string"


def brute_force(rows, window=20):
    """{doc_id: (n_words, n_removed, text)} by looking at every window in order."""
    seen, found = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = [w for i, w in enumerate(words) if i not in gone]
        found[doc_id] = (len(words), len(gone), b" ".join(kept).decode())
    return found


def got(spark, rows, **given):
    out = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), **given).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out}


def test_cover_has_every_difference():
    for difference in range(repeats.PERIOD):
        assert any((a - b) % repeats.PERIOD == difference for a in repeats.COVER for b in repeats.COVER)


def test_range_hashes_depend_on_the_words_alone():
    import pyarrow as pa

    words = split(pa.array(["a b c a b", "", None, " c  a\tb "]))
    assert words.ends.tolist() == [0, 5, 5, 5, 8]
    ranges = Ranges(words.hashes())
    import numpy as np

    starts = np.array([2, 5])
    for which in (0, 1):
        one, other = ranges.of(starts, starts + 3, which)
        assert one == other
    assert ranges.of(np.array([0]), np.array([2]), 0) == ranges.of(np.array([3]), np.array([5]), 0)
    assert ranges.of(np.array([0]), np.array([2]), 0) != ranges.of(np.array([1]), np.array([3]), 0)


@pytest.mark.parametrize("shift", range(14))
def test_passages_meet_at_every_shift(spark, shift):
    rng = random.Random(shift)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(20)
    rows = [(1, " ".join(fresh(30) + passage + fresh(9))), (2, " ".join(fresh(30 + shift) + passage)), (3, " ".join(passage[:19] + fresh(40)))]
    result = got(spark, rows)
    assert result == brute_force(rows)
    assert [result[i][1] for i in (1, 2, 3)] == [0, 20, 0]


def test_random_texts_of_few_words_match_brute_force(spark):
    rng = random.Random(7)
    pieces = [[f"p{i}x{rng.randrange(50)}" for _ in range(rng.choice([5, 15, 22, 40, 70]))] for i in range(12)]
    rows = []
    for doc_id in range(150):
        words = []
        for _ in range(rng.randrange(8)):
            words += rng.choice(pieces) if rng.random() < 0.6 else [f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
        rows.append((doc_id, " ".join(words)))
    rows += [(200, "la " * 500), (201, "la la " * 15), (202, "la lu " * 40), (203, None), (204, ""), (205, " \n\t ")]
    assert got(spark, rows) == brute_force(rows)
    assert got(spark, rows, window=13) == brute_force(rows, 13)


def test_one_line_in_all_documents_with_other_words_around(spark):
    rng = random.Random(3)
    line = [f"l{i}" for i in range(25)]
    rows = [(i, " ".join([f"a{rng.randrange(10**9)}" for _ in range(15)] + line[: 8 + i % 18] + [f"b{rng.randrange(10**9)}" for _ in range(15)])) for i in range(300)]
    assert got(spark, rows) == brute_force(rows)


def test_words_keep_their_case_and_other_spaces_do_not_part_them(spark):
    words = [f"é{i} x" for i in range(20)]
    rows = [(1, " ".join(words)), (2, "\r\n".join(words)), (3, " ".join(words).upper())]
    result = got(spark, rows)
    assert [result[i][:2] for i in (1, 2, 3)] == [(20, 0), (20, 20), (20, 0)]


def test_very_long_text_is_judged_whole(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x"] * 5 + words[200_000:200_050]))]
    result = got(spark, rows)
    assert result[1][:2] == (300_000, 0) and result[2] == (55, 50, "x x x x x")


def test_missing_and_repeated_ids_and_repeated_rows(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(25)) for c in "ab")
    out = repeats.remove_repeats(spark.createDataFrame([(None, a), (1, a), (1, a), (2, b), (2, b + " end")], SCHEMA)).collect()
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in out)
    # the row without an id comes first; of two rows of one id one comes first
    assert found[:3] == [(False, 0, 25, 0), (True, 1, 25, 25), (True, 1, 25, 25)]
    assert {(n, r) for _, _, n, r in found[3:]} in ({(25, 0), (26, 25)}, {(25, 25), (26, 0)})


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, at int, tag int").withColumn("key", F.lit(1))
    assert [tuple(r) for r in repeats.remove_repeats(docs).collect()] == [(1, 2, 0, "a b")]
    assert repeats.remove_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, window=12)
