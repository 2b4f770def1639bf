"""Names, texts and numbers as SQL text.

A frame may have hundreds of features. Writing one SQL expression over all of
them is much quicker to build than a column object per feature and step.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number_sql(value: float) -> str:
    """A double, exactly."""
    value = float(value)
    return f"{value!r}D" if math.isfinite(value) else f"CAST('{value!r}' AS DOUBLE)"


def array_of(values: Iterable[float]) -> Column:
    """ARRAY<DOUBLE> constant."""
    return F.expr(f"array({', '.join(number_sql(v) for v in values)})")


def point_of(features: Iterable[str]) -> Column:
    """The features of a row as one ARRAY."""
    return F.expr(f"array({', '.join(name_sql(f) for f in features)})")
