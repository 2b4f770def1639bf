"""Mean silhouette with plain Euclidean distances, over all points.

Every point needs its distance to every other one, so the work is quadratic in
the number of distinct points; no row per pair is ever produced. Equal points
are combined first. The distinct points are spread over blocks by hash, as
large as a task's memory allows, and each task gets two blocks and returns, per
point and cluster, one sum of distances. Distances are products of small parts of
the blocks, and those of close points, where a product loses digits, are computed
from the differences. What is computed doesn't depend on the
number of rows: the caller names the measure.

MANY points of few features and clusters are dealt by place, not by hash, and their sums
come from cells of neighbouring points (`cells`), which takes work that grows little
faster than the points. Sums are those of all pairs but for a share of less than 1e-8, as measured.

With a `step` every coordinate is snapped to a grid of that width before equal
points are combined, which is another measure: all rows still count, and no
distance is off by more than step * sqrt(dimensions).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sqltext import name_sql, number_sql
from tessera.operators import cells as by_place
from tessera.operators.clustering import vectorized
from tessera.session import shared_folder

#: Coordinates, or sums by cluster, of a block in bytes; rows of a block follow from the number of features and labels.
BLOCK_BYTES = 32 << 20
#: Pairs of blocks for each core, and rows of a block that aren't worth another one.
CELLS, LEAST_ROWS = 12, 2000
#: Rows of two blocks whose distances are computed at a time, and clusters among them that are added up by a product.
TILE, FEW = (128, 512), 8
#: Squared distances below this share of the squared norms are computed from differences.
NEAR = 1e-6
#: Clusters whose sums share a row.
BAND = 32
#: Distinct points from which sums come from cells, for at most so many features and clusters.
MANY, CELL_FEATURES, CELL_LABELS = 100_000, 6, 16
#: Points of a block of cells, and of a row of them.
PLACED, CHUNK = 200_000, 4096


def distinct_points(df: DataFrame, label: str, features: Sequence[str], step: float | None = None) -> DataFrame:
    """point ARRAY<DOUBLE>, label, weight: one row per distinct point and label."""
    coordinates = [f"CAST({name_sql(f)} AS DOUBLE)" for f in features]
    if step:
        width = number_sql(step)
        coordinates = [f"round({c} / {width}) * {width}" for c in coordinates]
    # adding zero turns -0.0 into 0.0
    point = F.expr(f"array({', '.join(f'{c} + 0D' for c in coordinates)})")
    return df.groupBy(point.alias("point"), F.col(label).alias("label")).agg(F.count("*").alias("weight"))


class _Rows:
    """Rows of a block that follow each other by cluster: what their distances to others need, and their sums by cluster."""

    def __init__(self, points: np.ndarray, cluster: np.ndarray, weight: np.ndarray, center: np.ndarray):
        self.points = points
        moved = points - center
        self.norms = np.square(moved).sum(axis=1)
        ones = np.ones(len(points))
        # one product of these two gives the squared distances: |a|^2 + |b|^2 - 2ab
        self.wide = np.column_stack([moved, self.norms, ones])
        self.tall = np.ascontiguousarray(np.column_stack([-2 * moved, ones, self.norms]).T)
        self.starts = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
        self.clusters, self.weight = cluster[self.starts], weight
        self.table = None
        if len(self.starts) <= FEW:
            self.table = np.zeros((len(points), len(self.starts)))
            self.table[np.arange(len(points)), np.searchsorted(self.starts, np.arange(len(points)), side="right") - 1] = weight

    def sums(self, distances: np.ndarray) -> np.ndarray:
        """Distances of others to these rows, a column each, added up by cluster."""
        if self.table is not None:
            return distances @ self.table
        return np.add.reduceat(distances * self.weight, self.starts, axis=1)


def _distances(a: _Rows, b: _Rows) -> np.ndarray:
    """All distances between two parts. Close pairs, where the product loses digits, are computed from their differences."""
    squared = a.wide @ b.tall
    bound = NEAR * (np.fmax.reduce(a.norms) + np.fmax.reduce(b.norms))
    if not squared.min() > bound:  # also if something is no number
        i, j = np.nonzero(~(squared > bound))
        if 8 * len(i) < squared.size:
            squared[i, j] = np.square(a.points[i] - b.points[j]).sum(axis=1)
        else:
            squared[:] = 0
            for x, y in zip(a.points.T, b.points.T, strict=True):
                gap = np.subtract.outer(x, y)
                gap *= gap
                squared += gap
    return np.sqrt(squared, out=squared)


def _parts(block: pa.Table, center: np.ndarray, rows: int) -> list[_Rows]:
    points, cluster, weight = _coordinates(block), block["cluster"].to_numpy(), block["weight"].to_numpy().astype(float)
    return [_Rows(points[i : i + rows], cluster[i : i + rows], weight[i : i + rows], center) for i in range(0, len(points), rows)]


def _coordinates(block: pa.Table) -> np.ndarray:
    """Points as rows of doubles; a missing coordinate is no number."""
    flat = block["point"].combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)


def _sums(width: int):
    """Task code: distances between two blocks, summed per point and cluster, in rows of so many clusters."""

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        low, high = (x.as_py() for x in key)
        cell = cell.sort_by("cluster")
        a, b = (cell.filter(pc.equal(cell["block"], x)) for x in (low, high))
        if not (a.num_rows and b.num_rows):
            return _banded([], width)
        points = _coordinates(a)
        finite = points[np.isfinite(points).all(axis=1)]
        center = finite.mean(axis=0) if len(finite) else np.zeros(points.shape[1])
        clusters_a, clusters_b = (np.unique(x["cluster"].to_numpy()) for x in (a, b))
        to_a, to_b = np.zeros((a.num_rows, len(clusters_b))), np.zeros((b.num_rows, len(clusters_a)))
        # so few rows at a time that the distances stay in the processor's cache
        with np.errstate(invalid="ignore", over="ignore"):
            left, right = _parts(a, center, TILE[0]), _parts(b, center, TILE[1])
            for i, one in enumerate(left):
                rows, own = slice(i * TILE[0], i * TILE[0] + len(one.points)), _places(clusters_a, one)
                for j, other in enumerate(right):
                    distances = _distances(one, other)
                    to_a[rows, _places(clusters_b, other)] += other.sums(distances)
                    if low != high:
                        to_b[j * TILE[1] : j * TILE[1] + len(other.points), own] += one.sums(distances.T)
        _without_numbers(to_a), _without_numbers(to_b)
        return _banded([(a, clusters_b, to_a)] if low == high else [(a, clusters_b, to_a), (b, clusters_a, to_b)], width)

    return run


def _without_numbers(sums: np.ndarray) -> None:
    """A point with a distance that is no number has no sums in the cell; an infinite distance only leaves its own cluster's."""
    infinite = np.isinf(sums)
    bad = ~np.isfinite(sums).all(axis=1)
    sums[bad] = np.where(infinite[bad] & (infinite[bad].sum(axis=1, keepdims=True) == 1), sums[bad], np.nan)


def _places(clusters: np.ndarray, part: _Rows) -> slice:
    """Where the part's clusters, which follow each other, are among those of its block."""
    first = int(np.searchsorted(clusters, part.clusters[0]))
    return slice(first, first + len(part.clusters))


def _banded(sums: list[tuple[pa.Table, np.ndarray, np.ndarray]], width: int) -> pa.Table:
    """(pid, band, totals): the sums of so many neighbouring clusters in one row; null without a member in the block, or if it is no number."""
    parts = []
    for block, clusters, totals in sums:
        bands = (clusters - 1) // width
        for band in np.unique(bands).tolist():
            row = np.full((block.num_rows, width), np.nan)
            row[:, (clusters[bands == band] - 1) % width] = totals[:, bands == band]
            offsets = pa.array(np.arange(0, row.size + 1, width), pa.int32())
            columns = [block["pid"].combine_chunks(), pa.array(np.full(len(row), band)), pa.ListArray.from_arrays(offsets, pa.array(row.ravel(), from_pandas=True))]
            parts.append(pa.Table.from_arrays(columns, ["pid", "band", "totals"]))
    kinds = pa.schema({"pid": pa.int64(), "band": pa.int64(), "totals": pa.list_(pa.float64())})
    return pa.concat_tables([x.cast(kinds) for x in parts]) if parts else kinds.empty_table()


def block_count(rows: int, features: int, labels: int, parallel: int) -> int:
    """Blocks that fill a task's memory with coordinates, or with sums by cluster, and make several pairs of blocks for each core.

    Pairs of blocks are dealt by hash, so that some tasks get more of them than others.
    """
    coordinates = BLOCK_BYTES // (8 * (features + 4))
    most = max(1, BLOCK_BYTES // (8 * (features + 4 + labels)), min(coordinates, math.isqrt(BLOCK_BYTES // 8)))
    return max(1, math.ceil(rows / most), min(math.ceil(math.sqrt(2 * CELLS * parallel)), math.ceil(rows / LEAST_ROWS)))


def _placed(points: DataFrame, features: int, blocks: int) -> tuple[Column, int]:
    """The block of a point, by its place: the widest side of every block is halved until there are so many."""
    sides = [F.get("point", F.lit(i)) for i in range(features)]
    tree: list = [None]
    while len(tree) < blocks:
        measured = [F.array(F.min(x), F.max(x), F.percentile_approx(x, 0.5, 1000).cast("double")) for x in sides]
        rows = points.groupBy(_leaf(tree, sides).alias("block")).agg(F.array(*measured).alias("sides")).collect()
        cuts = {}
        for row in rows:
            low, high, middle = max(row["sides"], key=lambda s: s[1] - s[0])
            side = row["sides"].index([low, high, middle])
            if low < high:
                cuts[row["block"]] = side, middle if middle < high else low + (high - low) / 2
        if not cuts:
            break
        tree = [path for block, old in enumerate(tree) for path in ([(old, *cuts[block], True), (old, *cuts[block], False)] if block in cuts else [old])]
    return _leaf(tree, sides), len(tree)


def _leaf(tree: list, sides: list[Column]) -> Column:
    """Number of the path through all cuts that a point is on."""
    def inside(path) -> Column:
        if path is None:
            return F.lit(True)
        above, side, cut, low = path
        here = sides[side] <= F.lit(cut)
        return inside(above) & (here if low else ~here)

    found = F.lit(len(tree) - 1)
    for block in reversed(range(len(tree) - 1)):
        found = F.when(inside(tree[block]), F.lit(block)).otherwise(found)
    return found.cast("int")


def _chunks(key: tuple, block: pa.Table) -> pa.Table:
    """Points of a block in rows of CHUNK points."""
    firsts = list(range(0, block.num_rows, CHUNK))
    parts = [block.slice(first, CHUNK) for first in firsts]
    listed = [[p[name].combine_chunks() for p in parts] for name in ("point", "cluster", "weight")]
    listed[0] = [p.flatten() for p in listed[0]]
    number = key[0].as_py()
    columns = [pa.array([number] * len(parts), pa.int32()), pa.array([(number << 32) + i for i in range(len(parts))], pa.int64())]
    for values in listed:
        offsets = np.cumsum([0, *map(len, values)])
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(values)))
    return pa.Table.from_arrays(columns, ["block", "chunk", "places", "clusters", "weights"])


def _cell_sums(features: int, labels: int):
    """Task code: distances between two blocks by cells, summed per point and cluster, a row for each chunk."""

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        low, high = (x.as_py() for x in key)
        parts = [cell.filter(pc.equal(cell["block"], x)) for x in ([low] if low == high else [low, high])]
        blocks, origin = [], None
        for part in parts:
            places = part["places"].combine_chunks().flatten().to_numpy().reshape(-1, features)
            clusters = part["clusters"].combine_chunks().flatten().to_numpy()
            weights = np.zeros((len(places), labels))
            weights[np.arange(len(places)), clusters - 1] = part["weights"].combine_chunks().flatten().to_numpy()
            origin = places.mean(axis=0) if origin is None else origin
            blocks.append(by_place.Block(places, weights, origin))
        by_place.meet(blocks[0], blocks[-1])
        found = []
        for part, block in zip(parts, blocks, strict=True):
            lengths = pc.list_value_length(part["weights"]).to_numpy() * labels
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            kept = [part[name] if low == high else pa.nulls(part.num_rows, part[name].type) for name in ("clusters", "weights")]
            found.append(pa.Table.from_arrays([part["chunk"], pa.ListArray.from_arrays(offsets, pa.array(block.result().ravel())), *kept], ["chunk", "totals", "clusters", "weights"]))
        return pa.concat_tables(found)

    return run


def _chunk_scores(sizes: list[int]):
    """Task code: silhouettes of the points of a chunk, from their sums over all blocks."""
    count = np.array(sizes, float)

    def run(rows: pa.Table) -> pa.Table:
        totals = 0.0
        for row in rows["totals"]:
            totals = totals + row.values.to_numpy().reshape(-1, len(count))
        own = rows.filter(pc.is_valid(rows["clusters"]))
        cluster, weight = (own[name].combine_chunks().flatten().to_numpy() for name in ("clusters", "weights"))
        at = np.arange(len(cluster)), cluster - 1
        near = totals[at] / np.maximum(count[cluster - 1] - 1, 1) * (count[cluster - 1] > 1)
        others = totals / count
        others[at] = np.inf
        far = others.min(axis=1)
        larger = np.maximum(near, far)
        known = np.isfinite(far) & (larger > 0)
        score = np.divide(far - near, larger, out=np.zeros(len(far)), where=known)
        return pa.Table.from_arrays([pa.array(cluster), pa.array(weight), pa.array(score)], ["cluster", "weight", "score"])

    return run


def _points_by_cells(points: DataFrame, sizes: DataFrame, features: int, count: int, parallel: int) -> DataFrame:
    """cluster, weight, score of finite points: blocks by place, and in every pair of blocks cells that are far apart meet as nodes."""
    listed = [row["n"] for row in sizes.orderBy("cluster").select("n").collect()]
    block, blocks = _placed(points, features, max(math.ceil(count / PLACED), min(math.ceil(math.sqrt(2 * CELLS * parallel)), math.ceil(count / LEAST_ROWS))))
    # an outlier's side of a cut may have few points, and one with all others too many: parts by hash are as good, but slower
    most = max(row["n"] for row in points.groupBy(block).agg(F.count("*").alias("n")).collect())
    parts = math.ceil(most / (2 * PLACED))
    if parts > 1:
        block, blocks = (block * parts + F.pmod(F.xxhash64("pid"), F.lit(parts))).cast("int"), blocks * parts
    spread = points.join(sizes, points["label"].eqNullSafe(sizes["label"])).select(block.alias("block"), "point", "weight", "cluster")
    packed = spread.groupBy("block").applyInArrow(_chunks, "block INT, chunk LONG, places ARRAY<DOUBLE>, clusters ARRAY<LONG>, weights ARRAY<LONG>").checkpoint()
    cells = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "chunk", "places", "clusters", "weights"
    )
    # many more tasks than pairs of blocks, so that few of them get two
    sums = cells.repartition(max(parallel, min(2 * blocks * blocks, parallel * 200)), "low", "high").groupBy("low", "high").applyInArrow(
        _cell_sums(features, len(listed)), "chunk LONG, totals ARRAY<DOUBLE>, clusters ARRAY<LONG>, weights ARRAY<LONG>"
    )
    return sums.groupBy("chunk").applyInArrow(_chunk_scores(listed), "cluster LONG, weight LONG, score DOUBLE")


def silhouette_points(
    df: DataFrame, label: str, features: Sequence[str], step: float | None = None, block_rows: int | None = None
) -> DataFrame:
    """cluster, weight, score: the silhouette of every distinct point. Clusters are numbered in the labels' order."""
    spark = df.sparkSession
    shared_folder(spark)
    # a task has one core: threads of its products would only wait for those of the other tasks
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    points = distinct_points(df, label, features, step)
    # ids must survive a lost executor, so they are written before use
    points = points.withColumn("pid", F.monotonically_increasing_id()).checkpoint()
    count = points.count()
    if not count:
        raise ValueError("Dataset is empty")
    # one row per label
    sizes = points.groupBy("label").agg(F.sum("weight").alias("n"))
    sizes = sizes.select("label", "n", F.row_number().over(Window.orderBy("label")).cast("long").alias("cluster"))
    labels = sizes.count()
    parallel = spark.sparkContext.defaultParallelism
    if count >= MANY and len(features) <= CELL_FEATURES and labels <= CELL_LABELS and block_rows is None:
        # 0 * x is no number if x isn't, or is infinite
        lost = F.exists("point", lambda x: x.isNull() | F.isnan(x * 0))
        if points.where(lost).isEmpty():
            return _points_by_cells(points, sizes, len(features), count, parallel)
    blocks = math.ceil(count / block_rows) if block_rows else block_count(count, len(features), labels, parallel)
    spread = points.join(sizes, points["label"].eqNullSafe(sizes["label"])).select(
        "pid", "point", "weight", "cluster", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int").alias("block")
    )
    # every unordered pair of blocks is one cell; each block goes to all cells it is part of
    width = min(BAND, labels)
    cells = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "pid", "point", "cluster", "weight",
    )
    tasks = max(parallel, min(blocks * (blocks + 1) // 2, parallel * blocks))
    sums = cells.repartition(tasks, "low", "high").groupBy("low", "high").applyInArrow(_sums(width), "pid LONG, band LONG, totals ARRAY<DOUBLE>")
    added = F.array(*[F.sum(F.get("totals", F.lit(i))) for i in range(width)])
    sums = sums.groupBy("pid", "band").agg(added.alias("totals")).select("pid", "band", F.posexplode("totals").alias("place", "total"))
    sums = sums.select("pid", (F.col("band") * width + F.col("place") + 1).alias("other"), "total")
    whole = sums.join(sizes.select(F.col("cluster").alias("other"), "n"), "other").join(spread.select("pid", "cluster", "weight"), "pid")
    own = F.col("other") == F.col("cluster")
    measured = whole.groupBy("pid", "cluster", "weight").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    near, far = F.coalesce("a", F.lit(0.0)), F.col("b")
    larger = F.greatest(near, far)
    # without another cluster there is nothing to compare with
    score = F.when(far.isNull() | (larger == 0), 0.0).otherwise((far - near) / larger)
    return measured.select("cluster", "weight", score.alias("score"))


def silhouette(df: DataFrame, label: str, features: Sequence[str], step: float | None = None) -> DataFrame:
    """One row: silhouette, points. Exact at any size unless a step is given."""
    return silhouette_points(df, label, features, step).agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("silhouette"),
        F.sum("weight").alias("points"),
    )


def silhouette_squared(df: DataFrame, label: str, features: Sequence[str]) -> float:
    """The other common silhouette, on squared distances: linear in the rows, a different number."""
    vectors = vectorized(df, features, [label]).withColumn("_prediction", F.col(label).cast("double"))
    evaluator = ClusteringEvaluator(predictionCol="_prediction", featuresCol="vector", metricName="silhouette")
    return float(evaluator.evaluate(vectors))
