"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numbers import number_text, trimmed


#: Holds the text of a row whose cells are too few or too many.
LEFT_OUT = "_left_out"


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, account: Observation | None = None) -> DataFrame:
    """Text columns, trimmed; rows with a cell too few or too many are left out.

    Numbers are read from the text later, cell by cell. Quoted commas stay, a
    doubled quote becomes one. Every file's header is held against the columns,
    and a file that has them in another order, or others, is an error. Pruning
    is off for the parser because it would skip the count of cells, and with it
    the check of the rows. An account tells, once the frame has been read whole,
    how many rows were kept and left_out, and the first of these in text order
    as example, from the same read.
    """
    raw, names = _raw(spark, path, columns, "DROPMALFORMED" if account is None else "PERMISSIVE")
    if account is not None:
        wrong = F.col(LEFT_OUT).isNotNull()
        counts = F.count_if(~wrong).alias("kept"), F.count_if(wrong).alias("left_out"), F.min(LEFT_OUT).alias("example")
        raw = raw.observe(account, *counts).where(~wrong)
    return raw.select(*[F.coalesce(trimmed(F.col(f"_c{i}")), F.lit("")).alias(name) for i, name in enumerate(names)])


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """(cells, kept, n_rows, no_first, example): how many rows have so many cells, the first cell empty, and the first record left out.

    Records are in text order. One read; rows are added up by their number of cells before the shuffle. A
    file without wrong rows gives one line.
    """
    raw, names = _raw(spark, path, None, "PERMISSIVE")
    record = F.col(LEFT_OUT)
    commas = F.length(F.regexp_replace(F.regexp_replace(record, '"[^"]*"', ""), "[^,]", ""))
    rows = raw.select(F.coalesce(commas + 1, F.lit(len(names))).alias("cells"), record.isNull().alias("kept"), record.alias("record"), "_c0")
    return rows.groupBy("cells", "kept").agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce("_c0", F.lit("")) == "").alias("no_first"), F.min("record").alias("example"))


def _raw(spark: SparkSession, path: str, columns: list[str] | None, mode: str) -> tuple[DataFrame, list[str]]:
    """Cells as _c0 and on, with the text of wrong rows if the mode keeps them, and the columns' names."""
    raw_names = read_header(spark, path)
    columns = columns or [c.strip() for c in raw_names]
    if len(columns) != len(raw_names):
        raise ValueError(f"{len(columns)} names for {len(raw_names)} columns")
    names = [*raw_names, LEFT_OUT] if mode == "PERMISSIVE" else raw_names
    raw = (
        spark.read.schema(T.StructType([T.StructField(name, T.StringType()) for name in names]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", LEFT_OUT)
        .option("columnPruning", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return raw.toDF(*[f"_c{i}" for i in range(len(columns))], *names[len(columns) :]), columns


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line of one file; a folder without a data row is an error."""
    shown = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    )
    if not shown.columns or shown.isEmpty():
        raise ValueError("a header and a row of data are needed")
    return shown.columns


def flatten(df: DataFrame, text: bool = True) -> DataFrame:
    """Nested structs as dotted columns, arrays as JSON text, missing values as ''.

    With text=False the leaf columns keep their types and their NULLs.
    """
    leaves: list[Column] = []

    def walk(parent: Column | None, fields: list[T.StructField], prefix: str) -> None:
        for field in fields:
            col = F.col(f"`{field.name}`") if parent is None else parent.getField(field.name)
            name = prefix + field.name
            if isinstance(field.dataType, T.StructType):
                walk(col, field.dataType.fields, name + ".")
            else:
                leaves.append(_leaf(col, field.dataType, text).alias(name))

    walk(None, df.schema.fields, "")
    return df.select(*leaves)


def _leaf(col: Column, dtype: T.DataType, text: bool) -> Column:
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        col = F.to_json(col)
    elif text and isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = number_text(col.cast("double"))
    return F.coalesce(col.cast("string"), F.lit("")) if text else col


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Flattened rows with a header; commas, quotes and line breaks are quoted."""
    (
        flatten(df)
        .write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )
