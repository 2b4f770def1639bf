"""k-means from several starts at once: seeded starting centres, and one scan per round for all of them.

Starting centres are drawn by squared distance. Drawing one row with a chance in
proportion to its weight needs no running total and no driver: every row draws a
uniform number u from a hash of its id, the seed and the step, and the row with the
largest weight / -ln(u) wins the race. A step is one aggregate over all seeds.

A round labels every row once per start and moves the centres of all starts in one
scan. A start is frozen when its labels are those of the round before; the fit
ends when all are. Distances are NumPy over Arrow batches: centres change with each
round, and as generated code they would be compiled anew each time. The rows are packed
once, SLICE rows in one, column by column, and kept for all rounds. A task adds
up its rows by start and centre, these sums are added by start and centre, and
the driver gets one row for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions.sqltext import name_sql
from tessera.operators.clustering import MAX_CENTERS, Centers

#: Inertias this close to the least one, as a share of it, count as equal: sums depend on the order of tasks.
SAME = 1e-9
#: Rows whose distances a task holds at a time.
SLICE = 4096


@dataclass(frozen=True)
class Fit:
    """Centres of one start when it ended, the inertia of the last labels, rounds, and whether the labels had settled."""

    start: int
    centers: Centers
    inertia: float
    rounds: int
    settled: bool


def uniform(row_id: str, seed: int, step: int) -> Column:
    """A number in (0, 1) from the id's text, the seed and the step: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed)), F.lit(str(step))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def draw_starts(points: DataFrame, row_id: str, features: Sequence[str], k: int, seeds: Sequence[int] = fixed.SEEDS) -> list[Centers]:
    """k starting centres per seed: any row first, then rows by their squared distance from the centres drawn so far.

    Where all rows lie on drawn centres, any row is drawn again. The result
    depends on the rows and their ids only, not on their order or partitions.
    """
    _checked(k * len(seeds))
    drawn: dict[int, list[tuple[int, list[float]]]] = {seed: [] for seed in seeds}
    for step in range(k):
        numbers = [uniform(row_id, seed, step).alias(f"u{i}") for i, seed in enumerate(seeds)]
        chosen = [np.array([c for _, c in drawn[seed]]) for seed in seeds]
        racers = points.select(*_doubles(features), *numbers).mapInArrow(_race(chosen, len(features)), "seed int, race double, u double, point array<double>")
        won = racers.groupBy("seed").agg(F.max(F.struct("race", "u", "point"))["point"].alias("point")).collect()
        if not won:
            raise ValueError("there are no rows to draw centres from")
        for row in won:
            drawn[seeds[row["seed"]]].append((step, [float(v) for v in row["point"]]))
    return [drawn[seed] for seed in seeds]


def _doubles(features: Sequence[str]) -> list[Column]:
    return [F.col(name_sql(f)).cast("double").alias(f"x{i}") for i, f in enumerate(features)]


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The first columns as rows of one array of doubles, and the others."""
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            columns = [c.to_numpy(zero_copy_only=False) for c in whole.slice(start, SLICE).columns]
            yield np.stack(columns[:width]), columns[width:]


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's squared distance from the nearest centre, and a line for each centre with 1 where it is that one, the first of equally near ones."""
    squares = np.empty((len(centers), x.shape[1]))
    gap = np.empty(x.shape[1])
    for total, center in zip(squares, centers, strict=True):
        np.subtract(x[0], center[0], out=total)
        total *= total
        for column, value in zip(x[1:], center[1:], strict=True):
            np.subtract(column, value, out=gap)
            np.multiply(gap, gap, out=gap)
            total += gap
    best = squares.min(axis=0)
    chosen = squares == best
    if np.count_nonzero(chosen) != x.shape[1]:  # equally near ones, or something is no number
        label = squares.argmin(axis=0)
        best, chosen = np.take_along_axis(squares, label[None], axis=0)[0], np.arange(len(centers))[:, None] == label
    return best, chosen


def _race(chosen: list[np.ndarray], width: int):
    """Each seed's winner among the rows of a task: (seed, race, u, point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, float, list[float]]] = {}
        for x, numbers in _slices(batches, width):
            for seed, (centers, u) in enumerate(zip(chosen, numbers, strict=True)):
                race = (_nearest(x, centers)[0] if len(centers) else 1.0) / -np.log(u)
                for i in np.flatnonzero(race == race.max()).tolist():
                    racer = float(race[i]), float(u[i]), x[:, i].tolist()
                    best[seed] = max(best.get(seed, racer), racer)
        seeds, races = list(best), list(zip(*best.values(), strict=True)) or [(), (), ()]
        kinds = (pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
        columns = [pa.array(v, kind) for v, kind in zip((seeds, *races), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["seed", "race", "u", "point"])

    return run


def fit_all(
    points: DataFrame, row_id: str, features: Sequence[str], starts: Sequence[Centers], rounds: int = fixed.MAX_ROUNDS
) -> list[Fit]:
    """Every start's fit, until its labels settle or for so many rounds. A centre nobody chose stays where it is."""
    _checked(sum(map(len, starts)))
    centers = [[(int(i), [float(v) for v in c]) for i, c in start] for start in starts]
    fits: dict[int, Fit] = {}
    signatures: dict[int, tuple] = {}
    # parts of the hash that add up without loss as doubles: a slice has less than 2^29 rows
    drop = F.xxhash64(F.col(name_sql(row_id)))
    parts = [F.shiftrightunsigned(drop, 24 * i).bitwiseAND(F.lit(0xFFFFFF)).cast("double").alias(f"h{i}") for i in range(3)]
    packed = points.select(*_doubles(features), *parts).mapInArrow(_packed(len(features) + 3), "columns binary")
    # a Python task costs a tenth of a second, each round
    packed = packed.coalesce(2 * points.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _rounds(packed, len(features), centers, fits, signatures, rounds)
    finally:
        packed.unpersist()
    return [fits.get(s) or Fit(s, centers[s], float("nan"), 0, False) for s in range(len(starts))]


def _rounds(packed: DataFrame, width: int, centers: list[list], fits: dict[int, Fit], signatures: dict[int, tuple], rounds: int) -> None:
    """Moves the centres until all starts have a fit."""
    for number in range(1, rounds + 1):
        moving = [s for s in range(len(centers)) if s not in fits]
        if not moving:
            break
        found = _round(packed, width, {s: centers[s] for s in moving})
        for s in moving:
            rows = found.get(s, {})
            signature = tuple(sorted((i, r["size"], *r["hashes"]) for i, r in rows.items()))
            settled = signatures.get(s) == signature
            signatures[s] = signature
            inertia = float(sum(r["squared"] for r in rows.values()))
            if not settled:
                centers[s] = [(i, list(rows[i]["center"]) if i in rows else c) for i, c in centers[s]]
            if settled or number == rounds:
                fits[s] = Fit(s, centers[s], inertia, number, settled)


def best_of(fits: Sequence[Fit]) -> Fit:
    """The fit with the least inertia, the earliest start of equal ones."""
    least = min(fit.inertia for fit in fits)
    return next(fit for fit in fits if fit.inertia <= least * (1 + SAME))


def _checked(count: int) -> None:
    if count > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centres in all starts")


def _packed(width: int):
    """Task code: SLICE rows in one, their doubles column by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _slices(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["columns"])

    return run


def _round(packed: DataFrame, width: int, moving: dict[int, Centers]) -> dict[int, dict[int, dict]]:
    """{start: {centre: size, sums of hashes that tell the labels, inertia, mean of its rows}} by one scan."""
    schema = "start int, id int, size long, hashes array<long>, squared double, sums array<double>"
    hashes, sums = (F.expr(f"array({', '.join(f'sum({name}[{i}])' for i in range(n))})").alias(name) for name, n in (("hashes", 3), ("sums", width)))
    added = packed.mapInArrow(_labelled(moving, width), schema).groupBy("start", "id")
    added = added.agg(F.sum("size").alias("size"), hashes, F.sum("squared").alias("squared"), sums)
    found: dict[int, dict[int, dict]] = {}
    for row in added.collect():
        center = [total / row["size"] for total in row["sums"]]
        found.setdefault(row["start"], {})[row["id"]] = row.asDict() | {"center": center}
    return found


def _labelled(moving: dict[int, Centers], width: int):
    """Sums of a task's rows by start and nearest centre, the lowest id of equally near ones."""
    sorted_centers = {s: sorted(centers) for s, centers in moving.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {s: _Totals(len(centers), width) for s, centers in sorted_centers.items()}
        places = {s: np.array([c for _, c in centers]) for s, centers in sorted_centers.items()}
        for columns in (value.as_py() for batch in batches for value in batch.column(0)):
            x = np.frombuffer(columns).reshape(width + 3, -1)
            for s, centers in places.items():
                totals[s].add(x, *_nearest(x[:width], centers))
        rows = [(s, centers[i][0], *totals[s].row(i)) for s, centers in sorted_centers.items() for i in np.flatnonzero(totals[s].size).tolist()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.float64()))
        columns = [pa.array(v, kind) for v, kind in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["start", "id", "size", "hashes", "squared", "sums"])

    return run


class _Totals:
    """Sums over the rows of each centre."""

    def __init__(self, centers: int, width: int):
        self.size, self.hashes = np.zeros(centers, np.int64), np.zeros((centers, 3), np.int64)
        self.squared, self.sums = np.zeros(centers), np.zeros((centers, width))

    def add(self, x: np.ndarray, squared: np.ndarray, chosen: np.ndarray) -> None:
        """Rows given column by column, the parts of their hashes last, with their squared distances and centres."""
        self.size += np.count_nonzero(chosen, axis=1)
        if np.isfinite(squared).all():
            added = chosen.astype(float) @ np.vstack([x, squared]).T
        else:  # a product with 0 would spread what is no number to all centres
            added = np.stack([np.where(c, [*x, squared], 0.0).sum(axis=1) for c in chosen])
        self.sums += added[:, :-4]
        self.hashes += added[:, -4:-1].astype(np.int64)
        self.squared += added[:, -1]

    def row(self, i: int) -> tuple:
        return int(self.size[i]), self.hashes[i].tolist(), float(self.squared[i]), self.sums[i].tolist()
