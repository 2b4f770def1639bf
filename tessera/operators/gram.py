"""Moments of many features at once: vector columns, added up in blocks.

A task multiplies blocks of rows in NumPy and keeps one matrix, whatever the
number of rows; the matrices are added row by row in further tasks, so that no
task holds more than one of them. The plan has two operators at any width.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features of a matrix: a task and the driver hold one matrix of them, 128 MB.
MAX_WIDTH = 4096
#: Bytes of a block of rows.
BLOCK = 8 << 20


@dataclass(frozen=True)
class Moments:
    """Rows, mean of every feature, and the sums of products of what differs from the mean."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def covariance(self, sample: bool = False) -> np.ndarray:
        rows = self.n - 1 if sample else self.n
        return self.scatter / rows if rows > 0 else np.full_like(self.scatter, np.nan)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors, all of one width, as rows of doubles."""
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != width * len(column):
        raise ValueError(f"a vector is null, holds null, or isn't {width} wide")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


def moments(df: DataFrame, vector: str, center: Sequence[float] | None = None) -> Moments:
    """Count, means and centred products of a vector column, in one scan.

    Products are of differences from `center`, by default the first vector
    met, and are then moved to the mean: nothing is lost where means are large
    and deviations small. Without rows the width is 0.
    """
    own = df.select(F.col(vector).cast("array<double>").alias("v"))
    if center is None:
        head = own.head()
        center = [] if head is None else head["v"]
        if head is not None and (center is None or None in center):
            raise ValueError("a vector is null or holds null")
    width, origin = len(center), np.asarray(center, np.float64)
    if width > MAX_WIDTH:
        raise ValueError(f"more than {MAX_WIDTH} features")
    if not width:
        return Moments(0, np.zeros(0), np.zeros((0, 0)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, step = np.zeros((width + 1, width + 1)), max(1, BLOCK // (8 * width))
        for batch in batches:
            for part in range(0, batch.num_rows, step):
                away = matrix(batch.column(0).slice(part, step), width) - origin
                total[:width, :width] += away.T @ away
                total[width, :width] += away.sum(axis=0)
                total[width, width] += len(away)
        yield _rows(range(width + 1), total)

    dealt = own.mapInArrow(products, "i int, sums array<double>").repartition("i")
    added = dealt.mapInArrow(_added, "i int, sums array<double>").collect()
    total = np.zeros((width + 1, width + 1))
    for row in added:
        total[row["i"]] = row["sums"]
    n, away = int(total[width, width]), total[width, :width]
    shift = away / n if n else away
    scatter = total[:width, :width] - n * np.outer(shift, shift)
    return Moments(n, origin + shift, (scatter + scatter.T) / 2)


def _rows(numbers, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(list(values), pa.list_(pa.float64()))], ["i", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all rows of a number; a task holds a few rows of the matrix."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = sums.values.to_numpy(zero_copy_only=False)
            held[i] = held[i] + values if i in held else values
    if held:
        yield _rows(list(held), held.values())
