"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A vector is turned by three rounds of random signs and a Hadamard transform;
the largest coordinate and its sign are its hash. Each table joins a few such
hashes into a bucket, and a vector also probes the buckets that its next
largest coordinates would have given. Vectors that meet are verified by their
cosine. Equal vectors are one class from the start. A bucket that many vectors
share is cut into blocks, and each pair of blocks is a cell of bounded size;
a cell returns one row per vector, never one per pair. A pair is counted in
the first table and bucket where it meets, nowhere else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import renamed, small_side, written
from tessera.llm.components import components

#: Least number of tables, further buckets that a vector probes in each, vectors of a block, vectors that a bucket should hold.
TABLES, PROBES, BLOCK, FILL = 6, 2, 1024, 500
THRESHOLD = 0.9
#: Share of the pairs at the threshold that tables are added for, by the share that one table finds of simulated pairs.
RECALL = 0.995
SEED = 7


def rotated(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Random signs and a fast Hadamard transform, three times; the width becomes a power of two."""
    width = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), width))
    out[:, : vectors.shape[1]] = vectors
    signs = np.random.default_rng([seed, width]).choice([-1.0, 1.0], (3, width))
    for turn in signs:
        out *= turn
        step = 1
        while step < width:
            pairs = out.reshape(len(out), -1, 2, step)
            low, high = pairs[:, :, 0, :] + pairs[:, :, 1, :], pairs[:, :, 0, :] - pairs[:, :, 1, :]
            out = np.stack([low, high], axis=2).reshape(len(out), width)
            step *= 2
        out /= math.sqrt(width)
    return out


def buckets(vectors: np.ndarray, table: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """(n, 1 + probes): each vector's bucket in a table, then those it probes, the nearest first. -1: none left."""
    n = len(vectors)
    best, codes, costs = np.zeros(n, np.int64), [], []
    for h in range(hashes):
        turned = rotated(vectors, SEED + 1000 * table + h)
        width = turned.shape[1]
        top = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, : probes + 1]
        value = np.take_along_axis(turned, top, 1)
        code = 2 * top + (value < 0)
        scale = (2 * width) ** h
        best += code[:, 0] * scale
        for i in range(1, top.shape[1]):  # one hash at a time gives way to its next coordinate
            codes.append((code[:, i] - code[:, 0]) * scale)
            costs.append(np.abs(value[:, 0]) - np.abs(value[:, i]))
    found = np.full((n, 1 + probes), -1, np.int64)
    found[:, 0] = best
    if codes:
        order = np.argsort(np.array(costs).T, axis=1, kind="stable")[:, :probes]
        found[:, 1 : 1 + order.shape[1]] = best[:, None] + np.take_along_axis(np.array(codes).T, order, 1)
    return found


def pairs_at(cosine: float, width: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of random unit vectors of exactly that cosine."""
    rng = np.random.default_rng([seed, width])
    one, other = rng.normal(size=(2, n, width))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return one, cosine * one + math.sqrt(1 - cosine**2) * other


def meet(one: np.ndarray, other: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """Does either vector of a pair probe the other's bucket in a table?"""
    mine, its = buckets(one, table, hashes), buckets(other, table, hashes)
    return (mine == its[:, :1]).any(axis=1) | (its == mine[:, :1]).any(axis=1)


def tables_for(width: int, hashes: int) -> int:
    """So many tables that pairs at the threshold meet in one of them: the more hashes a table joins, the more tables."""
    if width < 2:
        return TABLES
    one, other = pairs_at(THRESHOLD, width, 500, SEED)
    share = np.mean([meet(one, other, 100_000 + table, hashes).mean() for table in range(12)])
    return TABLES if share == 1 else max(TABLES, math.ceil(math.log(1 - RECALL) / math.log(1 - max(share, 1e-3))))


def recall(width: int, hashes: int, tables: int) -> float:
    """Share of simulated pairs at the threshold that meet in one of the tables."""
    one, other = pairs_at(THRESHOLD, width, 1000, SEED + 1)
    found = np.zeros(len(one), bool)
    for table in range(tables):
        found |= meet(one, other, table, hashes)
    return float(found.mean())


def plan(width: int, n: int, hashes: int | None = None) -> tuple[int, int]:
    """(hashes, tables) for n vectors of a width: so many hashes that a bucket holds about FILL vectors of random directions.

    Narrow vectors have too few rotations for many hashes; they join fewer, down
    to one, until pairs at the threshold meet.
    """
    if hashes is not None:
        return hashes, tables_for(width, hashes)
    hashes = max(1, math.ceil(math.log(max(n, 1) / FILL) / math.log(2 * (1 << max(1, (width - 1).bit_length())))))
    hashes = min(hashes, 62 // max(1, (2 * width - 1).bit_length() + 1) or 1)  # a bucket's number is a signed 64-bit one
    while hashes > 1 and width > 1 and recall(width, hashes, tables_for(width, hashes)) < 0.99:
        hashes -= 1
    return hashes, tables_for(width, hashes)


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of a batch, for each length of vector."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.r_[0, np.cumsum(lengths)]
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        some = flat[starts[rows][:, None] + np.arange(length)[None, :]]
        yield rows, some / np.linalg.norm(some / np.abs(some).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(some).max(axis=1, keepdims=True)


def _placed(plans: dict[int, tuple[int, int]], slim: bool):
    """Each class in each of its buckets: (table, width, bucket) and, unless slim, what a cell needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 1000):
                batch = whole.slice(part, 1000)
                for rows, units in _matrix(batch.column("embedding")):
                    hashes, tables = plans[1 << max(1, (units.shape[1] - 1).bit_length())]
                    codes = np.stack([buckets(units, table, hashes) for table in range(tables)], axis=1)
                    which, table, probe = np.nonzero(codes >= 0)
                    columns = [pa.array(table.astype(np.int32)), pa.array(np.full(len(which), units.shape[1], np.int32)), pa.array(codes[which, table, probe])]
                    names = ["table", "width", "bucket"]
                    if not slim:
                        packed = [x.tobytes() for x in codes.astype("<i8")]
                        data = [x.tobytes() for x in units.astype("<f8")]
                        take = pa.array(rows[which])
                        columns += [batch.column("cid").take(take), batch.column("n").take(take), pa.array(probe > 0)]
                        columns += [pa.array([data[i] for i in which], pa.binary()), pa.array([packed[i] for i in which], pa.binary())]
                        names += ["cid", "n", "probe", "unit", "codes"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector of a cell that has links there: (a, b, links), b the smallest class it is connected to."""
    held = None
    for batch in batches:
        both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = np.stack([both.column(x).to_numpy() for x in ("table", "width", "bucket", "low", "high")])
        fresh = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)] if both.num_rows else np.array([], bool)
        starts = np.flatnonzero(fresh)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a > 1:
                yield from _cell(both.slice(a, b - a))
        held = both.slice(int(starts[-1])) if len(starts) else None
    if held is not None and held.num_rows > 1:
        yield from _cell(held)


def _cell(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    table, bucket, low, high = (rows.column(x)[0].as_py() for x in ("table", "bucket", "low", "high"))
    cid, n, block = (rows.column(x).to_numpy() for x in ("cid", "n", "block"))
    main = ~rows.column("probe").to_numpy()
    units = np.frombuffer(b"".join(rows.column("unit").to_pylist()), "<f8").reshape(len(cid), -1)
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<i8").reshape(len(cid), -1, 1 + PROBES)
    links, label, ends = np.zeros(len(cid), np.int64), np.arange(len(cid)), []
    for part in range(0, len(cid), 256):
        here = np.arange(part, min(part + 256, len(cid)))
        near = units[here] @ units.T >= THRESHOLD
        near &= main[here][:, None] | main[None, :]
        near &= cid[here][:, None] < cid[None, :]
        if low != high:  # two blocks: only pairs between them
            near &= block[here][:, None] != block[None, :]
        i, j = np.nonzero(near)
        for some in range(0, len(i), 50_000):
            one, other = here[i[some : some + 50_000]], j[some : some + 50_000]
            mine, its = codes[one], codes[other]
            to_other = (mine == its[:, :, :1]).any(axis=2)  # one probes the bucket of other
            to_one = (its == mine[:, :, :1]).any(axis=2)
            first = (to_other | to_one).argmax(axis=1) == table
            home, away = mine[:, table, 0], its[:, table, 0]
            where = np.where(to_other[:, table] & to_one[:, table], np.minimum(home, away), np.where(to_other[:, table], away, home))
            counted = first & (where == bucket)
            one, other = one[counted], other[counted]
            np.add.at(links, one, n[other])
            np.add.at(links, other, n[one])
            ends.append((one, other))
    one, other = (np.concatenate(x) if ends else np.array([], np.int64) for x in (zip(*ends, strict=True) if ends else ((), ())))
    while len(one):
        least = label.copy()
        np.minimum.at(least, one, label[other])
        np.minimum.at(least, other, label[one])
        least = least[least]
        if (least == label).all():
            break
        label = least
    linked = np.flatnonzero(links)
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(cid[linked]), pa.array(cid[label[linked]]), pa.array(links[linked])], ["a", "b", "links"])


def class_links(classes: DataFrame, hashes: int | None = None) -> DataFrame:
    """(a, b, links) over (cid, n, embedding): linked rows of a by cell, b a class that a is connected to."""
    log = F.length(F.bin(F.size("embedding") - 1))  # of the power of two that a width is filled up to
    widths = classes.groupBy(log.alias("log")).agg(F.max(F.size("embedding")).alias("width"), F.count("*").alias("n")).collect()
    plans = {1 << r.log: plan(r.width, r.n, hashes) for r in widths}
    slim = classes.select("cid", "n", "embedding").mapInArrow(_placed(plans, True), "table int, width int, bucket long")
    sizes = slim.groupBy("table", "width", "bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK)
    crowded = written(sizes.select("table", "width", "bucket", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")))
    schema = "table int, width int, bucket long, cid long, n long, probe boolean, unit binary, codes binary"
    rows = classes.select("cid", "n", "embedding").mapInArrow(_placed(plans, False), schema)
    rows = rows.join(small_side(crowded, 8 << 20, 32), ["table", "width", "bucket"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = rows.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).drop("blocks", "other")
    key = ["table", "width", "bucket", "low", "high"]
    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(_cells, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", hashes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Links join rows whose vectors have a cosine of 0.9 or more; n_links counts
    the other rows linked directly. Vectors that are null, empty, zero or hold
    null, NaN or infinite components, and those of another length, link with
    nothing. A row without a vec_id is linked like others but names no
    component. Repeated rows are linked with each other; an empty table gives
    an empty one.
    """
    rows = renamed(vectors, vec_id=vec_id, embedding=vectors[embedding].cast("array<double>"))
    infinite = F.lit(float("inf"))
    valid = F.size("embedding") > 0
    valid &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("embedding", lambda x: x != 0)
    rows = written(rows.select("*", F.coalesce(valid, F.lit(False)).alias("valid")))
    equal = rows.where("valid").groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = written(equal.select("*", F.monotonically_increasing_id().alias("cid")))
    found = written(class_links(classes, hashes))
    direct = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> b").select("a", "b"))
    rooted = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(smallest, "root").join(direct.withColumnRenamed("a", "cid"), "cid", "left")
    known = known.select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("valid").join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
