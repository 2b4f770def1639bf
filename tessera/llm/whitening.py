"""Whitened embeddings: principal components by a pivoted Cholesky factor and one-sided Jacobi rotations.

The scatter of the distinct vectors about their mean is added up by Spark in
blocks. It is factored as L L' with pivoting; rotations from the right make the
columns of the triangular L orthogonal, pair by pair, without forming a product
again, so that small eigenvalues keep their digits. Then the squared length of a
column is an eigenvalue of the scatter, and the column over its length the
component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.vector_codes import prepared
from tessera.operators.gram import matrix, moments

#: Steps of one unit, components that are returned.
STEPS, COMPONENTS = 256, 4
#: Share of the largest pivot below which the rest is taken for rounding.
NOTHING = 1e-14
SLICE = 4096


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L' = a for a symmetric matrix without negative eigenvalues; one column per rank.

    In each step the largest entry left on the diagonal is the pivot. Rows stay
    where they are, so L is triangular in the order of the pivots.
    """
    rest, columns = np.array(a, np.float64), []
    left, limit = np.ones(len(a), bool), NOTHING * max(np.diag(a).max(initial=0.0), 0.0)
    for _ in range(len(a)):
        diagonal = np.where(left, np.diag(rest), -np.inf)
        pivot = int(diagonal.argmax())
        if diagonal[pivot] <= limit:
            break
        column = np.where(left, rest[:, pivot], 0.0) / np.sqrt(diagonal[pivot])
        columns.append(column)
        left[pivot] = False
        rest -= np.outer(column, column)
    return np.stack(columns, axis=1) if columns else np.zeros((len(a), 0))


def rounds_of_pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of pairs that share no column."""
    players, rounds = list(range(n + n % 2)), []
    for _ in range(len(players) - 1):
        half = len(players) // 2
        pairs = [(a, b) for a, b in zip(players[:half], players[: half - 1 : -1], strict=True) if a < n and b < n]
        rounds.append(tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2)
        players = [players[0], players[-1], *players[1:-1]]
    return rounds


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(squared lengths, unit columns) of the factor with its columns rotated until they are orthogonal, longest first."""
    u, rounds, tolerance = factor.copy(), rounds_of_pairs(factor.shape[1]), 1e-15 * max(len(factor), 1) ** 0.5
    for _ in range(sweeps):
        moved = False
        for i, j in rounds:
            a, b = u[:, i], u[:, j]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            moved = True
            i, j, a, b = i[turn], j[turn], a[:, turn], b[:, turn]
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = 1 / np.sqrt(1 + t * t)
            u[:, i], u[:, j] = c * (a - t * b), c * (t * a + b)
        if not moved:
            break
    values = (u * u).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], u[:, order] / np.sqrt(values[order])


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, sums of their components, unit components as columns, variances, and the sum of all variances."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.variances)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sum)^2 of each row, exact; None where it is beyond 64 bits."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        kind = np.int64 if most * most * x.shape[1] < 1 << 63 else object
        away = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1).tolist()]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, total): sums of the components, and the number of rows at place -1."""
    total = None
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            some = np.r_[len(flat), flat.sum(axis=0)]
            total = some if total is None else total + some
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total) - 1, dtype=np.int32)), pa.array(total)], ["place", "total"])


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of distinct vectors x, each counted once; the frame should be written already."""
    found = distinct.select("x").mapInArrow(_sums, "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = [row["total"] for row in sorted(found, key=lambda row: row["place"])]
    if not total:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    n, sums = total[0], tuple(total[1:])
    scatter = moments(distinct, "x", [s / n for s in sums]).scatter
    values, vectors = jacobi(pivoted_cholesky(scatter))
    return Whitening(n, sums, vectors[:, :components], values[:components] / n, float(np.trace(scatter)) / n)


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest difference between the covariance of the whitened vectors and the identity, measured over the rows."""
    if not model.components.size:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, SLICE):
                x = model.whiten(matrix(batch.column(0).slice(part, SLICE), len(model.sums)))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], ["w"])

    white = distinct.select("x").mapInArrow(run, "w array<double>")
    covariance = moments(white, "w", [0.0] * len(model.variances)).covariance()
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Rows whose vector is null, empty or holds null, NaN or infinite components
    are left out. The fit counts equal vectors once; repeated rows are returned
    as often as they come. Components are numbered from 1 by falling variance;
    of equal variances any order and any axes in their plane hold. A component
    without variance has no direction: whitened is null and explained 0.
    identity_error is null if none has variance; deviation is null beyond 64
    bits. Vectors of different widths and components of 2^28 / steps or more
    raise a ValueError. An empty table gives an empty one; other columns are
    neither read nor returned.
    """
    rows = prepared(vectors, vec_id, embedding, steps)
    distinct = written(rows.select("x").distinct())
    model = fit(distinct, components)
    error, shown = identity_error(distinct, model), min(components, len(model.sums))
    known = model.components.shape[1]
    share = np.r_[model.variances / model.trace if known else [], np.zeros(shown - known)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, SLICE):
                batch = whole.slice(part, SLICE)
                n = batch.num_rows
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
                white = np.full((n, shown), np.nan)
                white[:, :known] = model.whiten(x)
                take = np.repeat(np.arange(n), shown)
                columns = [
                    batch.column("vec_id").take(pa.array(take)),
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * shown, model.n)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(take)),
                    pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                    pa.array(np.tile(share, n)),
                    pa.array([error] * (n * shown), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
