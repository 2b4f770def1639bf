"""Runs registered queries against their SQL: python tests/check_oracles.py [folder] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def views(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def sort_key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def compare(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if rows, names and types agree, else what differs."""
    columns = sorted(frame.columns)
    got = [tuple(normal(row[c]) for c in columns) for row in frame.collect()]
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    kinds = dict(zip(names, (str(t[1]) for t in result.description)))
    order = [names.index(c) for c in columns]
    want = [tuple(normal(row[i]) for i in order) for row in result.fetchall()]
    described = {d[0]: d[1] for d in connection.execute(f"DESCRIBE {sql}").fetchall()}
    for name, kind in frame.dtypes:
        if SPARK_TYPES.get(kind, kind) != described[name]:
            return f"type of {name}: {kind} != {described[name]} ({kinds[name]})"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"{columns}\n   spark {a}\n   sql   {b}"
    return None


def main() -> int:
    from tessera.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    connection = views(folder)
    failed = 0
    for name, function in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            frame = function(spark, folder)
            problem = f"rows only: {len(frame.collect())}" if sql is None else compare(frame, connection, sql)
            bad = sql is not None and problem is not None
        except Exception as error:  # report and go on with the next query
            problem, bad = f"{type(error).__name__}: {str(error)[:1500]}", True
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
