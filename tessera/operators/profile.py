"""Column profile: class, nulls, exact distinct count, samples and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import fixed_values as fixed
from tessera.functions.numbers import cell_number, cell_text, is_calendar, number_text
from tessera.session import shared_folder


def _numbers(df: DataFrame, columns: Sequence[str], mode: str, *extra: str) -> DataFrame:
    """Every column as a number _n0, _n1, ... and, where it may hold text, as text _t0, _t1, ..."""
    texts, numbers = [], []
    for position, name in enumerate(columns):
        dtype, col = df.schema[name].dataType, F.col(f"`{name}`")
        only_numbers = isinstance(dtype, T.NumericType) or (mode == "lenient" and is_calendar(dtype))
        if only_numbers:
            texts.append(col.alias(f"_c{position}"))
            number = cell_number(F.col(f"_c{position}"), dtype, mode)
        else:
            texts.append(cell_text(col, dtype).alias(f"_t{position}"))
            number = cell_number(col, dtype, mode, F.col(f"_t{position}"))
            numbers.append(F.col(f"_t{position}"))
        # adding zero turns -0.0 into 0.0
        numbers.append((number + F.lit(0.0)).alias(f"_n{position}"))
    # texts first, so that every text is trimmed once
    return df.select(*extra, *texts).select(*extra, *numbers)


def _cells(df: DataFrame, columns: Sequence[str], mode: str, *extra: str) -> DataFrame:
    """One row per cell: column position, number, text (NULL for a number)."""
    read = _numbers(df, columns, mode, *extra)
    cells = []
    for position in range(len(columns)):
        number, text = F.col(f"_n{position}"), F.lit(None).cast("string")
        if f"_t{position}" in read.columns:
            text = F.when(number.isNull(), F.col(f"_t{position}"))
        cells.append(F.struct(F.lit(position).alias("position"), number.alias("number"), text.alias("text")))
    return read.select(*extra, F.inline(F.array(*cells)))


def distinct_values(df: DataFrame, columns: Sequence[str], mode: str = "lenient", row_id: str | None = None) -> DataFrame:
    """One row per column and distinct value: rows and, with a row id, the first row that has it.

    A hot value is combined before the shuffle.
    """
    if row_id is None:
        return _cells(df, columns, mode).groupBy("position", "number", "text").agg(F.count("*").alias("rows"))
    cells = _cells(df.withColumn("_row", F.col(row_id)), columns, mode, "_row")
    return cells.groupBy("position", "number", "text").agg(F.count("*").alias("rows"), F.min("_row").alias("first_row"))


def column_counts(df: DataFrame, columns: Sequence[str], mode: str = "lenient") -> DataFrame:
    """Per column position: null_count, unique_count, numeric and non-null cells."""
    return _counts(distinct_values(df, columns, mode))


def _counts(values: DataFrame) -> DataFrame:
    empty = F.col("number").isNull() & F.col("text").isNull()
    return (
        values.groupBy("position")
        .agg(
            F.sum(F.when(empty, F.col("rows")).otherwise(0)).alias("null_count"),
            F.count_if(~empty).alias("unique_count"),
            F.sum(F.when(F.col("number").isNotNull(), F.col("rows")).otherwise(0)).alias("number_count"),
            F.sum(F.when(~empty, F.col("rows")).otherwise(0)).alias("value_count"),
        )
    )


def approximate_counts(df: DataFrame, columns: Sequence[str], mode: str = "lenient") -> DataFrame:
    """column_counts with an estimated unique_count: one pass and no shuffle of values."""
    read = _numbers(df, columns, mode)
    parts = []
    for position in range(len(columns)):
        number, text = F.col(f"_n{position}"), F.lit(None).cast("string")
        value = number
        if f"_t{position}" in read.columns:
            text = F.when(number.isNull(), F.col(f"_t{position}"))
            value = F.coalesce(number.cast("string"), text)
        parts.append(
            F.struct(
                F.lit(position).alias("position"),
                F.count_if(number.isNull() & text.isNull()).alias("null_count"),
                F.approx_count_distinct(value).alias("unique_count"),
                F.count(number).alias("number_count"),
                (F.count(number) + F.count(text)).alias("value_count"),
            )
        )
    return read.agg(F.array(*parts).alias("_counts")).select(F.inline("_counts"))


def column_statistics(df: DataFrame, columns: Sequence[str], mode: str = "lenient") -> DataFrame:
    """min, max, mean and population deviation of the numeric cells, one pass, no shuffle of rows."""
    one_row = _numbers(df, columns, mode).agg(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.min(f"_n{position}").alias("min"),
                F.max(f"_n{position}").alias("max"),
                F.avg(f"_n{position}").alias("mean"),
                F.stddev_pop(f"_n{position}").alias("std_dev"),
            ).alias(f"s{position}")
            for position in range(len(columns))
        ]
    )
    return one_row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))


def column_samples(df: DataFrame, row_id: str, columns: Sequence[str] | None = None, mode: str = "lenient") -> DataFrame:
    """The first distinct values of each column in row order: position, rank, value.

    The rank filter lets Spark keep five rows per column and task before the shuffle.
    """
    return _samples(distinct_values(df, columns or df.columns, mode, row_id))


def _samples(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("position").orderBy("first_row", "number", "text")
    return (
        values.where(F.col("number").isNotNull() | F.col("text").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= fixed.SAMPLE_SIZE)
        .select("position", "rank", F.coalesce(F.col("text"), number_text(F.col("number"))).alias("value"))
    )


def column_class(numbers: Column, values: Column, distinct: Column) -> Column:
    """numeric, categorical or text, by share of numbers and by distinct values."""
    return (
        F.when(numbers > values * F.lit(fixed.NUMERIC_SHARE), "numeric")
        .when(
            (distinct <= fixed.CATEGORY_MAX_DISTINCT) & (distinct < values * F.lit(fixed.CATEGORY_MAX_SHARE)),
            "categorical",
        )
        .otherwise("text")
    )


def _refuse_empty(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("Dataset is empty")


def profile(
    df: DataFrame,
    row_id: str | None = None,
    columns: Sequence[str] | None = None,
    mode: str = "lenient",
    samples: bool = True,
    exact: bool = True,
) -> DataFrame:
    """One row per column.

    position, name, type, null_count, unique_count, sample, and stats (NULL
    unless numeric). Without a row_id, samples follow the order of the file
    partitions. exact=False estimates unique_count, which for key-like columns
    of a very large table saves shuffling nearly every value. Counts and samples
    come from one grouping, which is written once. No row is an error.
    """
    _refuse_empty(df)
    columns = list(columns or [c for c in df.columns if c != "_row_id"])
    names = F.array(*[F.lit(c) for c in columns])
    if samples and row_id is None:
        row_id, df = "_row_id", df.withColumn("_row_id", F.monotonically_increasing_id())
    values = None
    if samples:
        shared_folder(df.sparkSession)
        values = distinct_values(df, columns, mode, row_id).checkpoint()
    # columns, not rows: every frame below has one row per column of the input
    if exact:
        counts = _counts(values) if samples else column_counts(df, columns, mode)
    else:
        counts = approximate_counts(df, columns, mode)
    result = (
        counts.join(column_statistics(df, columns, mode), "position")
        .withColumn("name", F.element_at(names, F.col("position") + 1))
        .withColumn("type", column_class(F.col("number_count"), F.col("value_count"), F.col("unique_count")))
        .withColumn("stats", F.when(F.col("type") == "numeric", F.struct("min", "max", "mean", "std_dev")))
    )
    if samples:
        first = (
            _samples(values)
            .groupBy("position")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("ranked"))
            .select("position", F.transform("ranked", lambda r: r["value"]).alias("sample"))
        )
        result = result.join(first, "position", "left").withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))
    else:
        result = result.withColumn("sample", F.array().cast("array<string>"))
    return result.select("position", "name", "type", "null_count", "unique_count", "sample", "stats")


def profile_summary(df: DataFrame, columns: Sequence[str] | None = None, mode: str = "lenient") -> DataFrame:
    """One row: counts of rows and columns by class, with the summary text. No row is an error."""
    _refuse_empty(df)
    columns = list(columns or df.columns)
    counts = column_counts(df, columns, mode)
    kind = column_class(F.col("number_count"), F.col("value_count"), F.col("unique_count"))
    totals = counts.agg(
        F.max(F.col("null_count") + F.col("value_count")).alias("row_count"),
        F.count("*").alias("column_count"),
        F.count_if(kind == "numeric").alias("numeric_count"),
        F.count_if(kind != "numeric").alias("categorical_count"),
    )
    text = F.format_string(fixed.SUMMARY_TEXT, "row_count", "column_count", "numeric_count")
    return totals.withColumn("summary", text)


def analysis(
    df: DataFrame, row_id: str | None = None, columns: Sequence[str] | None = None, mode: str = "lenient", min_rows: int = fixed.MIN_ROWS
) -> DataFrame:
    """The whole profile as one row: row_count, column_count, columns, summary. Fewer than min_rows rows are an error."""
    if df.limit(min_rows).count() < min_rows:
        raise ValueError(f"at least {min_rows} rows are needed")
    columns = list(columns or [c for c in df.columns if c != "_row_id"])
    fields = ("name", "type", "null_count", "unique_count", "sample", "stats")
    # one row per column is gathered, never rows of the data
    gathered = profile(df, row_id, columns, mode).agg(
        F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("column")))).alias("ranked")
    )
    rows = df.agg(F.count("*")).scalar()
    numeric = F.size(F.filter("columns", lambda c: c["type"] == "numeric"))
    return (
        gathered.select(rows.alias("row_count"), F.transform("ranked", lambda r: r["column"]).alias("columns"))
        .withColumn("column_count", F.size("columns"))
        .withColumn("summary", F.format_string(fixed.SUMMARY_TEXT, "row_count", "column_count", numeric))
        .select("row_count", "column_count", "summary", "columns")
    )


def has_min_rows(df: DataFrame, minimum: int = fixed.MIN_ROWS) -> DataFrame:
    """One row saying whether the input has enough rows; reads no more than needed."""
    return df.select(F.lit(1)).limit(minimum).agg((F.count("*") >= minimum).alias("has_min_rows"))


def preview(df: DataFrame, order: Sequence[str], rows: int = fixed.PREVIEW_ROWS) -> DataFrame:
    """The first rows and columns as shown on screen, long texts cut."""
    shown = df.columns[: fixed.PREVIEW_COLUMNS]
    cells = [
        F.substring(F.col(f"`{c}`"), 1, fixed.PREVIEW_CHARS).alias(c)
        if isinstance(df.schema[c].dataType, T.StringType)
        else F.col(f"`{c}`")
        for c in shown
    ]
    if len(df.columns) > fixed.PREVIEW_COLUMNS:
        cells.append(F.lit("...").alias("more"))
    return df.orderBy(*order).limit(rows).select(*cells)
