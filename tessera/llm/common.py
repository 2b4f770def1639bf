"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The frame as written once to the shared checkpoint folder: no lineage, no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written_alone(df: DataFrame) -> DataFrame:
    """As `written`, and the shuffles behind it are deleted once it is written, not when the driver collects garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return written(df.select("*"))  # a frame takes the setting up as it is made
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def renamed(df: DataFrame, **names: str | Column) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash."""
    return df.select(*((df[c] if isinstance(c, str) else c).alias(new) for new, c in names.items()))


def small_side(df: DataFrame, limit_bytes: int, row_bytes: int) -> DataFrame:
    """Hints a broadcast if the counted rows stay below the limit; else Spark shuffles the side.

    The frame should be written already, as its rows are counted here.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df
