from datetime import date, datetime

import pytest

from tessera.operators.projection import Feature, project, type_at

SCHEMA = "id INT, flag INT, info STRUCT<born: DATE, seen: TIMESTAMP, vip: BOOLEAN, spend: DOUBLE, orders: INT, `odd name`: STRING>"
ROWS = [
    (1, 7, (date(1990, 1, 1), datetime(2020, 1, 3, 4), True, 10.0, 4, "x")),
    (2, 8, (None, None, None, None, None, None)),
    (3, 9, None),
    (4, 10, (date(2021, 1, 1), datetime(2019, 1, 1), False, 5.0, 0, "")),
]


def rows(spark, features, **more):
    return [tuple(r) for r in project(spark.createDataFrame(ROWS, SCHEMA), features, ["id"], **more).orderBy("id").collect()]


def test_every_kind_with_and_without_values(spark):
    features = [
        Feature("age", "info.born", "age"),
        Feature("idle", "info.seen", "days", default=-5),
        Feature("vip", "info.vip", "flag"),
        Feature("has_born", "info.born", "present"),
        Feature("mean", "info.spend", "ratio", by="info.orders", digits=2),
        Feature("text", "info.odd name", default="?"),
        Feature("orders", "info.orders", to="bigint", default=0),
    ]
    assert rows(spark, features, snapshot="2020-01-05") == [
        (1, 30, 2, 1, 1, 2.5, "x", 4),
        (2, None, -5, 0, 0, None, "?", 0),
        (3, None, -5, 0, 0, None, "?", 0),
        (4, -1, 369, 0, 1, None, "", 0),
    ]


def test_all_faults_are_told_at_once(spark):
    features = [
        Feature("id", "info.born", "age"), Feature("a", "info.none"), Feature("b", "id.x"), Feature("c", "flag", "flag"),
        Feature("d", "info.born", "ratio", by="info.orders"), Feature("e", "info.spend", "ratio"), Feature("f", "id", "sum"),
        Feature("g", "info.vip", "flag", default=1), Feature("h", "info.born", "present", to="int"),
    ]
    with pytest.raises(ValueError) as error:
        project(spark.createDataFrame(ROWS, SCHEMA), features, ["id", "nothing"])
    for part in (
        "the name id comes 2 times", "no column nothing", "a: there is no field info.none", "b: there is no field id.x", "c: flag is of type int",
        "d: info.born is of type date", "e: a ratio", "f: no kind is called sum", "g: flag is never missing", "h: only a value is cast", "id: age needs a snapshot",
    ):
        assert part in str(error.value), part


def test_only_the_fields_asked_for_are_read(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "records"))
    made = project(spark.read.parquet(str(tmp_path / "records")), [Feature("vip", "info.vip", "flag")])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<info:struct<vip:boolean>>" in plan
    assert type_at(made.schema, "vip").simpleString() == "int"
