"""Covariance and principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions.sqltext import name_sql, number_sql
from tessera.operators.features import Scaler
from tessera.operators.gram import moments


def covariance_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sample covariance of every pair: feature_i, feature_j, covariance.

    One aggregate over the rows; every pair is computed once and mirrored.
    """
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1)]
    one_row = df.agg(*[F.covar_samp(f"`{features[i]}`", f"`{features[j]}`").alias(f"c{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(
            F.lit(features[i]).alias("feature_i"),
            F.lit(features[j]).alias("feature_j"),
            F.col(f"c{max(i, j)}_{min(i, j)}").alias("covariance"),
        )
        for i in range(len(features))
        for j in range(len(features))
    ]
    return one_row.select(F.inline(F.array(*cells)))


def vector_covariance(df: DataFrame, vector: str, sample: bool = True) -> DataFrame:
    """Covariance of every pair of places of a vector column: feature_i, feature_j, covariance.

    The rows are read once and multiplied in blocks; the plan doesn't grow with
    the width.
    """
    spread = moments(df, vector).covariance(sample)
    rows = [(i, j, float(value)) for i, row in enumerate(spread) for j, value in enumerate(row)]
    return df.sparkSession.createDataFrame(rows, "feature_i INT, feature_j INT, covariance DOUBLE")


def fit_vector_components(df: DataFrame, vector: str, count: int = fixed.COMPONENTS) -> Components:
    """Leading components of a vector column; features are named by their place."""
    found = moments(df, vector)
    if not found.n:
        raise ValueError("Dataset is empty")
    names = tuple(str(i) for i in range(len(found.mean)))
    return _components(names, [float(m) for m in found.mean], found.covariance(), count)


@dataclass(frozen=True)
class Components:
    """Loadings (one list per component) and each component's share of the kept variance."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]
    shares: tuple[float, ...]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        scores = [f"{self._score(loading)} AS pc{i + 1}" for i, loading in enumerate(self.loadings)]
        return df.selectExpr(*[name_sql(c) for c in keep], *scores)

    def _score(self, loading: Sequence[float]) -> str:
        return " + ".join(
            f"({name_sql(f)} - {number_sql(m)}) * {number_sql(w)}" for f, m, w in zip(self.features, self.means, loading)
        )

    def share_frame(self, df: DataFrame) -> DataFrame:
        """One row per component."""
        rows = [(i + 1, share) for i, share in enumerate(self.shares)]
        return df.sparkSession.createDataFrame(rows, "component INT, share DOUBLE")


def fit_components(
    df: DataFrame, features: Sequence[str], count: int = fixed.COMPONENTS, standardized: bool = False
) -> Components:
    """Leading components; shares are of the kept variance, so they add up to 1, or are 0 without variance.

    One aggregate over the rows; means and the feature-by-feature covariance
    come back. With `standardized` the features are taken as scaled already.
    """
    scaler, spread = _moments(df, features)
    means = (0.0,) * len(scaler.features) if standardized else scaler.means
    return _components(scaler.features, means, spread, count)


def fit_scaled_components(df: DataFrame, features: Sequence[str], count: int = fixed.COMPONENTS) -> tuple[Scaler, Components]:
    """The scaler of raw features and the components of what it makes of them, from one aggregate."""
    scaler, spread = _moments(df, features)
    stds = np.array(scaler.stds)
    return scaler, _components(scaler.features, (0.0,) * len(stds), spread / np.outer(stds, stds), count)


def _moments(df: DataFrame, features: Sequence[str]) -> tuple[Scaler, np.ndarray]:
    """Means, deviations and population covariances, all from one pass."""
    features = tuple(features)
    if not features:
        raise ValueError("no features given")
    pairs = [(i, j) for i in range(len(features)) for j in range(i)]
    sums = [f"avg({name_sql(f)})" for f in features] + [f"stddev_pop({name_sql(f)})" for f in features]
    sums += [f"covar_pop({name_sql(features[i])}, {name_sql(features[j])})" for i, j in pairs]
    row = df.agg(F.count("*").alias("n"), F.expr(f"array({', '.join(sums)})").alias("moments")).first()
    if row["n"] == 0:
        raise ValueError("Dataset is empty")
    m = len(features)
    means, stds, mixed = row["moments"][:m], row["moments"][m : 2 * m], row["moments"][2 * m :]
    spread = np.diag(np.square(stds))
    for (i, j), value in zip(pairs, mixed):
        spread[i, j] = spread[j, i] = value
    return Scaler.of(features, means, stds), spread


def _components(features: tuple[str, ...], means: Sequence[float], spread: np.ndarray, count: int) -> Components:
    """Eigenvectors of a small matrix; the largest loading of each is positive."""
    values, vectors = np.linalg.eigh(spread)
    order = np.argsort(-values, kind="stable")[: min(count, len(features))]
    loadings = [vectors[:, c] * (1 if vectors[np.argmax(np.abs(vectors[:, c])), c] >= 0 else -1) for c in order]
    kept = [max(float(values[c]), 0.0) for c in order]
    total = sum(kept)
    shares = tuple(v / total if total > 0 else 0.0 for v in kept)
    return Components(features, tuple(means), tuple(tuple(float(w) for w in x) for x in loadings), shares)
