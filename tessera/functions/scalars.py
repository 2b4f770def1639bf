"""Column expressions for distances, ratios, bands, labels and money."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed_values as fixed
from tessera.functions.sqltext import array_of


def squared_distance(left: Column, right: Column) -> Column:
    """Squared Euclidean distance of two ARRAY<DOUBLE> of the same length."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, term: total + term
    )


def nearest(point: Column, centers: Sequence[tuple[int, Sequence[float]]]) -> Column:
    """STRUCT<squared, id> of the nearest centre; the lowest id wins a tie."""
    candidates = F.array(*[F.struct(F.lit(int(i)).alias("id"), array_of(c).alias("center")) for i, c in centers])
    return F.array_min(
        F.transform(
            candidates,
            lambda c: F.struct(squared_distance(point, c["center"]).alias("squared"), c["id"].alias("id")),
        )
    )


def cohesion(avg_distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + avg_distance)


def quality_label(score: Column, scale: str = "report") -> Column:
    """Name of a silhouette score on the 'report' or the 'screen' scale."""
    steps = {"report": fixed.REPORT_QUALITY, "screen": fixed.SCREEN_QUALITY}[scale]
    chain = reduce(lambda acc, step: acc.when(score > step[0], step[1]), steps, F)
    return chain.otherwise(F.lit(fixed.LOWEST_QUALITY))


def quality_advice(score: Column) -> Column:
    label = quality_label(score, "screen")
    return reduce(lambda acc, item: acc.when(label == item[0], item[1]), fixed.QUALITY_ADVICE.items(), F)


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal."""
    return F.round(F.lit(100.0) * part / whole, 1)


def percent_text(percent: Column) -> Column:
    return F.format_string("%.1f%%", percent)


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, negative if end comes first."""
    return F.datediff(end, start)


def age_years(born: Column, on: Column) -> Column:
    """Days divided by 365, rounded down; NULL if the date is missing."""
    return F.floor(days_between(born, on) / F.lit(365)).cast("int")


def churn_propensity(days_inactive: Column, base_rate: float = fixed.RETAIL_BASE_RATE) -> Column:
    recency = F.lit(1.0) / (
        F.lit(1.0) + F.exp(F.lit(-fixed.RECENCY_SLOPE) * (days_inactive - F.lit(fixed.RECENCY_MIDPOINT)))
    )
    return F.lit(base_rate) + F.lit(1 - base_rate) * recency * F.lit(fixed.RECENCY_WEIGHT)


def safe_ratio(part: Column, whole: Column, digits: int, empty: float | None = None) -> Column:
    """part / whole where whole is positive, else the given value. Decimal money is divided exactly."""
    return F.when(whole > 0, F.round(part / whole, digits).cast("double")).otherwise(F.lit(empty).cast("double"))


def banded(value: Column, cuts: Sequence[float] = fixed.INCOME_CUTS, names: Sequence[str] = fixed.INCOME_BANDS) -> Column:
    """Name of the first band whose upper bound exceeds the value."""
    if len(names) != len(cuts) + 1:
        raise ValueError("one more name than cut points is needed")
    chain = reduce(lambda acc, step: acc.when(value < step[0], step[1]), zip(cuts, names), F)
    return chain.when(value.isNotNull(), F.lit(names[-1]))


def as_flag(condition: Column) -> Column:
    """Boolean as 0 / 1; a missing one is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def present_flag(value: Column) -> Column:
    return value.isNotNull().cast("int")


def direction(kind: Column, credit_types: Sequence[str] = fixed.CREDIT_TYPES) -> Column:
    return F.when(kind.isin(*credit_types), F.lit("Credit")).otherwise(F.lit("Debit"))


def large_outflow(
    amount: Column, kind: Column, credit_types: Sequence[str] = fixed.CREDIT_TYPES, limit: float = fixed.LARGE_OUTFLOW
) -> Column:
    return (amount > limit) & (direction(kind, credit_types) != "Credit")


def loan_repayment(principal: Column, rate_percent: Column, months: Column) -> Column:
    """Monthly annuity; a loan without interest is paid in equal parts."""
    monthly = rate_percent / F.lit(1200.0)
    # the rate is nulled where it is zero so that no branch divides by zero
    charged = F.nullif(monthly, F.lit(0.0))
    annuity = principal * charged / (F.lit(1.0) - F.pow(F.lit(1.0) + charged, -months))
    equal_parts = F.round(money(principal) / months, 2).cast("double")
    return F.coalesce(F.round(annuity, 2), equal_parts)


def price_from_margin(cost: Column, margin: Column) -> Column:
    """Exact decimal cost * (1 + margin), two decimals."""
    return F.round(cost.cast("decimal(18,2)") * (F.lit(1) + margin.cast("decimal(8,4)")), 2)


def padded_id(prefix: str, number: Column, width: int = 6) -> Column:
    """'CUST-000001'; a number wider than the width is kept whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix + "-"), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def money(value: Column) -> Column:
    """Two-decimal money as an exact decimal, so that sums do not depend on row order."""
    return value.cast("decimal(18,2)")
