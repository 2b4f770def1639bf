"""Choosing features, building the numeric matrix, standardising it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions.numbers import cell_number
from tessera.functions.sqltext import name_sql, number_sql


def feature_candidates(profiled: DataFrame) -> DataFrame:
    """The numeric columns of a profile, with what one needs to choose among them."""
    return profiled.where(F.col("type") == "numeric").select(
        "position", "name", "stats.min", "stats.max", "stats.mean", "null_count", "unique_count"
    )


def valid_proposals(profiled: DataFrame, proposed: Sequence[str]) -> DataFrame:
    """Proposed columns that exist and are numeric, in proposed order, repeats kept."""
    names = F.array(*[F.lit(c) for c in proposed]).cast("array<string>")
    offered = profiled.sparkSession.range(1).select(F.posexplode(names).alias("rank", "name"))
    return offered.join(feature_candidates(profiled).select("name"), "name", "left_semi").select("rank", "name")


def recommend_features(profiled: DataFrame, answer: str | None = None) -> DataFrame:
    """One row: columns, reasoning, confidence.

    The answer is the JSON text of an outside adviser with the fields columns,
    reasoning and confidence. Unreadable text keeps the first three numeric
    columns, an answer without a usable column the first six; an empty text and
    null are such answers. No answer at all keeps the first four.
    """
    candidates = feature_candidates(profiled).select("position", "name")
    ordered = candidates.agg(F.sort_array(F.collect_list(F.struct("position", "name"))).alias("c")).select(
        F.transform("c", lambda x: x["name"]).alias("available")
    )
    ordered = ordered.withColumn(
        "available",
        F.when(F.size("available") > 0, F.col("available")).otherwise(
            F.raise_error(F.lit("none of the columns is numeric"))
        ),
    )
    if answer is None:
        return ordered.select(
            F.slice("available", 1, fixed.FAILED_COLUMNS).alias("columns"),
            F.lit(None).cast("string").alias("reasoning"),
            F.lit(None).cast("double").alias("confidence"),
        )
    schema = "columns ARRAY<STRING>, reasoning STRING, confidence DOUBLE, _broken STRING"
    parsed = ordered.withColumn(
        "a", F.from_json(F.lit(answer), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    )
    usable = F.filter(F.col("a.columns"), lambda c: F.array_contains("available", c))
    blank = F.lit(answer.strip() in ("", "null"))
    broken = ~blank & (F.col("a").isNull() | F.col("a._broken").isNotNull())
    found = F.coalesce(F.size(usable) > 0, F.lit(False))
    return parsed.select(
        F.when(broken, F.slice("available", 1, fixed.UNREADABLE_COLUMNS))
        .when(found, usable)
        .otherwise(F.slice("available", 1, fixed.NONE_VALID_COLUMNS))
        .alias("columns"),
        F.when(broken, F.lit(answer))
        .when(found, F.coalesce(F.col("a.reasoning"), F.lit(fixed.ANSWER_REASONING)))
        .otherwise(F.lit(fixed.NONE_VALID_REASONING))
        .alias("reasoning"),
        F.when(broken, F.lit(fixed.UNREADABLE_CONFIDENCE))
        .when(found, F.coalesce(F.col("a.confidence"), F.lit(fixed.ANSWER_CONFIDENCE)))
        .otherwise(F.lit(fixed.NONE_VALID_CONFIDENCE))
        .alias("confidence"),
    )


def feature_matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), mode: str = "lenient") -> DataFrame:
    """The chosen features as DOUBLE columns; whatever is not a number becomes 0."""
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        *[
            F.coalesce(cell_number(F.col(f"`{c}`"), df.schema[c].dataType, mode), F.lit(0.0)).alias(c)
            for c in features
        ],
    )


def expand_vector(df: DataFrame, vector: str, size: int, keep: Sequence[str], prefix: str = "f") -> tuple[DataFrame, list[str]]:
    """An ARRAY column of known length as DOUBLE columns f00, f01, ..."""
    names = [f"{prefix}{i:0{len(str(size - 1))}d}" for i in range(size)]
    kept = [name_sql(c) for c in keep]
    cells = [f"CAST(get({name_sql(vector)}, {i}) AS DOUBLE) AS {n}" for i, n in enumerate(names)]
    return df.selectExpr(*kept, *cells), names


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations of the features; a zero deviation counts as 1."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    @classmethod
    def of(cls, features: Sequence[str], means: Sequence[float], stds: Sequence[float]) -> Scaler:
        return cls(tuple(features), tuple(means), tuple(_usable(s) for s in stds))

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        scaled = [
            f"({name_sql(f)} - {number_sql(m)}) / {number_sql(s)} AS {name_sql(f)}"
            for f, m, s in zip(self.features, self.means, self.stds)
        ]
        return df.selectExpr(*[name_sql(c) for c in keep], *scaled)


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    """One aggregate over the features; two numbers per feature come back."""
    if not features:
        raise ValueError("no features given")
    row = df.agg(
        F.count("*").alias("n"),
        F.expr(f"array({', '.join(f'avg({name_sql(f)})' for f in features)})").alias("means"),
        F.expr(f"array({', '.join(f'stddev_pop({name_sql(f)})' for f in features)})").alias("stds"),
    ).first()
    if row["n"] == 0:
        raise ValueError("Dataset is empty")
    return Scaler.of(features, row["means"], row["stds"])


def _usable(std: float) -> float:
    return 1.0 if std == 0 or math.isnan(std) else float(std)


