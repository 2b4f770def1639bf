"""Shards by weighted rendezvous hashing of a stable record key.

Every shard draws an exponential time from the hash of (key, shard), divided
by its weight; the first to come takes the record. A further shard only draws
times of its own, so records move into it and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import renamed, written

#: Rows that one task numbers at most, on average.
ROWS_A_BUCKET = 200_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that takes a key: 0 to len(weights) - 1. Null keys are one key.

    Equal draws, of which 2^-52 of all pairs of shards are, go to the lower number.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("each shard needs a weight above 0")
    draws = []
    for shard, weight in enumerate(weights):
        uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
        draws.append(F.struct((-F.log(uniform) / F.lit(float(weight))).alias("t"), F.lit(shard).alias("s")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["s"]


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    size is the text's UTF-8 bytes plus 1; a null text has no bytes and the
    checksum of none. slot numbers a shard's rows from 0 without gaps.
    Repeated rows and rows with a null doc_id are sharded and numbered like
    others; an empty table gives an empty one.
    """
    data = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    rows = renamed(docs, doc_id=doc_id, size=F.length(data).cast("long") + 1, text_crc32=F.crc32(data))
    placed = written(
        rows.select(
            "*",
            F.lit("key").alias("law"),
            rendezvous(F.col("doc_id"), weights).alias("shard"),
            rendezvous(F.col("doc_id"), grown).alias("grown_shard"),
            F.monotonically_increasing_id().alias("_place"),
        )
    )
    return _numbered(placed).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _numbered(placed: DataFrame) -> DataFrame:
    """Adds slot. Shards are few and large, so each is dealt into buckets by row, not by key: one key may fill a third."""
    buckets = max(1, -(-placed.count() // ROWS_A_BUCKET), int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = placed.withColumn("_bucket", F.pmod(F.xxhash64("_place"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    # one row per shard and bucket: the rows of the table divided by the rows of a bucket
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "_place")
    return rows.withColumn("_row", F.row_number().over(own)).join(starts, ["shard", "_bucket"]).withColumn(
        "slot", F.col("_before") + F.col("_row") - 1
    )
