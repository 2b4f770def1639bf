"""A declared projection: features of a wide, nested record, compiled to one select.

Each feature says where its value is (a path of field names), what is made of it
and how it is called. The whole list is checked against the schema before
anything runs: unknown paths, types that a kind can't use, and names that come
twice are all reported at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import age_years, as_flag, days_between, present_flag, safe_ratio
from tessera.functions.sqltext import name_sql


@dataclass(frozen=True)
class Feature:
    """One column of the projection.

    kind: "value" as it is, cast to `to` if given; "flag" a boolean as 0 / 1;
    "present" 1 if there is a value; "age" whole years from a date to the
    snapshot; "days" whole days from it; "ratio" the path's value divided by that
    of `by`, rounded to `digits` where `by` is positive. `default` stands in for a
    missing value of the kinds "value", "age", "days" and "ratio".
    """

    name: str
    path: str
    kind: str = "value"
    to: str | None = None
    by: str | None = None
    digits: int = 6
    default: object = None


KINDS = {
    "value": None,
    "flag": (T.BooleanType,),
    "present": None,
    "age": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "days": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "ratio": (T.NumericType,),
}


def type_at(schema: T.StructType, path: str) -> T.DataType | None:
    """The type a path of field names leads to; None if it leads nowhere or through something that isn't a record."""
    found: T.DataType = schema
    for name in path.split("."):
        if not isinstance(found, T.StructType) or name not in found.fieldNames():
            return None
        found = found[name].dataType
    return found


def problems(schema: T.StructType, features: Sequence[Feature], keep: Sequence[str] = (), snapshot: str | None = None) -> list[str]:
    """What is wrong with a declaration, one sentence each."""
    said, names = [], [*keep, *(f.name for f in features)]
    said += [f"the name {name} comes {names.count(name)} times" for name in dict.fromkeys(names) if names.count(name) > 1]
    said += [f"there is no column {name}" for name in keep if name not in schema.fieldNames()]
    for f in features:
        if f.kind not in KINDS:
            said.append(f"{f.name}: no kind is called {f.kind}")
            continue
        for path in (f.path, *([f.by] if f.by else [])):
            found, wanted = type_at(schema, path), KINDS[f.kind]
            if found is None:
                said.append(f"{f.name}: there is no field {path}")
            elif wanted and not isinstance(found, wanted):
                said.append(f"{f.name}: {path} is of type {found.simpleString()}, which {f.kind} can't use")
        if (f.kind == "ratio") != (f.by is not None):
            said.append(f"{f.name}: a ratio, and nothing else, is by another field")
        if f.kind in ("age", "days") and snapshot is None:
            said.append(f"{f.name}: {f.kind} needs a snapshot")
        if f.to is not None and f.kind != "value":
            said.append(f"{f.name}: only a value is cast")
        if f.default is not None and f.kind in ("flag", "present"):
            said.append(f"{f.name}: {f.kind} is never missing")
    return said


def project(df: DataFrame, features: Sequence[Feature], keep: Sequence[str] = (), snapshot: str | None = None) -> DataFrame:
    """The kept columns and the declared features of every row; ValueError says all that is wrong with the declaration."""
    said = problems(df.schema, features, keep, snapshot)
    if said:
        raise ValueError("; ".join(said))
    day = F.lit(snapshot).cast("date")
    return df.select(*[F.col(name_sql(c)) for c in keep], *[_column(f, day).alias(f.name) for f in features])


def _column(f: Feature, day: Column) -> Column:
    at = F.col(".".join(map(name_sql, f.path.split("."))))
    if f.kind == "flag":
        return as_flag(at)
    if f.kind == "present":
        return present_flag(at)
    if f.kind == "age":
        value = age_years(at.cast("date"), day)
    elif f.kind == "days":
        value = days_between(at.cast("date"), day)
    elif f.kind == "ratio":
        value = safe_ratio(at, F.col(".".join(map(name_sql, f.by.split(".")))), f.digits)
    else:
        value = at.cast(f.to) if f.to else at
    return value if f.default is None else F.coalesce(value, F.lit(f.default))
