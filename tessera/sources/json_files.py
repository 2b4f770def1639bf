"""JSON in and out: one object per line, or files holding one array of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines, which many tasks can write and read; NULL fields are written too."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, arrays: bool = False) -> DataFrame:
    """Reads JSON Lines, or with arrays=True files that hold one array of objects each."""
    return spark.read.schema(schema).option("multiLine", arrays).json(path)
