import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding


def test_slots_have_no_gaps_and_growth_moves_rows_into_the_new_shard_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.assign(docs, [1.0] * 8, [1.0] * 9).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) > 0.5 * len(rows) / 8
    assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in rows)
    assert 0.05 < sum(r.grown_shard == 8 for r in rows) / len(rows) < 0.2
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_weights(spark):
    shards = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s"), sharding.rendezvous(F.col("id"), [1.0, 3.0, 4.0]).alias("t"))
    first = shards.where("s = 0").count()
    assert abs(first / 20_000 - 0.25) < 0.02
    assert shards.where("t <> s and t <> 2").count() == 0
    assert abs(shards.where("t = 2").count() / 20_000 - 0.5) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [1.0, 0.0])


def test_nulls_hot_keys_and_clashing_columns(spark, edge_docs, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BUCKET", 7)
    docs = edge_docs([None, "", "x"] + ["same"] * 5)
    hot = docs.union(docs.withColumn("doc_id", F.lit(3).cast("long"))).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.assign(hot, [1.0] * 8, [1.0] * 9).collect()
    assert len(rows) == 24
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert {r["size"] for r in rows if r.doc_id == 0} == {1}
    assert sharding.assign(docs.limit(0), [1.0], [1.0, 1.0]).count() == 0


def test_no_python_in_the_plan(spark):
    plan = sharding.assign(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), [1.0] * 8, [1.0] * 9)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
