from functools import reduce
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators.features import feature_matrix
from tessera.session import scratch_path, shared_folder
from tessera.sources.csv_files import csv_cells, flatten, read_csv, write_csv
from tessera.sources.json_files import read_json, write_json
from tessera.sources import run_store
from tessera.sources.run_store import DuplicateRun, RunStore


def test_csv_rows_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a, b ,c\n1,2,3\n4,5\n6,7,8,9\n\n"x,y", he ,"say ""hi"""\r\n,,\n5,  q ,\n')
    df = read_csv(spark, str(tmp_path))
    assert df.columns == ["a", "b", "c"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3"), ("x,y", "he", 'say "hi"'), ("", "", ""), ("5", "q", "")]
    # the rows do not depend on what is asked of them
    assert df.count() == 4 and len(df.select("a").collect()) == 4 and df.where("b = '2'").count() == 1
    assert [r["a"] for r in feature_matrix(df, ["a"]).collect()] == [1.0, 0.0, 0.0, 5.0]


@pytest.mark.parametrize("text", ["a,b\n", ""])
def test_csv_without_rows_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(text)
    with pytest.raises(ValueError, match="a header and a row of data"):
        read_csv(spark, str(tmp_path))


def nested(spark):
    return spark.createDataFrame(
        [(1, 5.0, (("s", None), "x, \"y\""), ["p", "q"], None), (2, 12345678.5, None, [], "t")],
        "id INT, v DOUBLE, address STRUCT<geo: STRUCT<street: STRING, no: INT>, city: STRING>, tags ARRAY<STRING>, note STRING",
    )


def test_flatten(spark):
    flat = flatten(nested(spark))
    assert flat.columns == ["id", "v", "address.geo.street", "address.geo.no", "address.city", "tags", "note"]
    assert [tuple(r) for r in flat.orderBy("id").collect()] == [
        ("1", "5", "s", "", 'x, "y"', '["p","q"]', ""), ("2", "12345678.5", "", "", "", "[]", "t"),
    ]


def test_csv_and_json_give_back_what_was_written(spark, tmp_path):
    write_csv(nested(spark), str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flatten(nested(spark)).collect()))
    write_json(nested(spark), str(tmp_path / "json"))
    again = read_json(spark, str(tmp_path / "json"), nested(spark).schema)
    assert sorted(again.collect(), key=lambda r: r["id"]) == nested(spark).orderBy("id").collect()


def test_json_arrays(spark, tmp_path):
    (tmp_path / "t.json").write_text('[\n {"id": 1},\n {"id": 2}\n]')
    assert read_json(spark, str(tmp_path), "id INT", arrays=True).agg(F.sum("id")).first()[0] == 3


def run(spark, run_id, day, **extra):
    row = {"id": run_id, "file_name": f"{run_id}.csv", "created_at": dt.datetime(2024, 1, day), "features": ["a", "b"],
           "num_clusters": 5, "row_count": 10, "silhouette_score": 0.5, **extra}
    return spark.createDataFrame([row], "id STRING, file_name STRING, created_at TIMESTAMP, features ARRAY<STRING>, num_clusters INT, row_count LONG, silhouette_score DOUBLE")


def test_run_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    assert store.list().count() == 0 and store.get("r1").count() == 0
    store.append(run(spark, "r1", 1).unionByName(run(spark, "2024-01", 3, features=None)))
    with pytest.raises(DuplicateRun, match="r1"):
        store.append(run(spark, "r1", 9, file_name="other.csv").unionByName(run(spark, "r2", 2)))
    store.append(run(spark, "r2", 2))
    listed = store.list().collect()
    assert [r["id"] for r in listed] == ["2024-01", "r2", "r1"]
    assert [r["feature_count"] for r in listed] == [0, 2, 2] and listed[2]["file_name"] == "r1.csv"
    got = store.get("r1").first()
    assert got["features"] == ["a", "b"] and got["clustering_results"] is None
    store.delete("r1")
    store.delete("never there")
    assert [r["id"] for r in store.list().collect()] == ["2024-01", "r2"] and store.get("r1").isEmpty()
    store.append(run(spark, "r1", 9))
    assert store.get("r1").first()["created_at"].day == 9


def test_an_id_that_comes_twice_is_refused(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    with pytest.raises(DuplicateRun):
        store.append(run(spark, "r", 5).unionByName(run(spark, "r", 4, file_name="first.csv")))
    assert store.list().count() == 0


def test_runs_share_buckets_and_one_of_them_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run_store, "BUCKETS", 2)
    store = RunStore(spark, str(tmp_path))
    store.append(reduce(lambda a, b: a.unionByName(b), [run(spark, f"r{i}", 1 + i) for i in range(8)]))
    assert len(list((tmp_path / "runs").glob("bucket=*"))) == 2
    store.delete("r2")
    store.delete("r3")
    assert sorted(r["id"] for r in store.list().collect()) == ["r0", "r1", "r4", "r5", "r6", "r7"]
    assert store.get("r5").first()["created_at"].day == 6 and store.get("r2").isEmpty()
    plan = store.get("r5")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_run_labels(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    assert store.labels("r1").isEmpty()
    labels = spark.createDataFrame([(1, 0), (2, 1)], "cust LONG, prediction INT")
    store.save_labels("r1", labels.withColumn("prediction", F.lit(7)), "cust")
    store.save_labels("r1", labels, "cust")
    store.save_labels("r3", labels, "cust")
    assert sorted((r["row_id"], r["prediction"]) for r in store.labels("r1").collect()) == [("1", 0), ("2", 1)]
    assert store.labels("r2").isEmpty()
    store.delete("r1")
    assert store.labels("r1").isEmpty() and store.labels("r3").count() == 2


def test_csv_files_with_other_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,5\n2,6\n")
    (tmp_path / "b.csv").write_text("x,id\n7,3\n")
    with pytest.raises(Exception, match="CSV header does not conform|header"):
        read_csv(spark, str(tmp_path)).collect()
    (tmp_path / "b.csv").write_text("id,x\n3,7\n")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path)).collect())) == [("1", "5"), ("2", "6"), ("3", "7")]
    assert read_csv(spark, str(tmp_path), ["u", "v"]).columns == ["u", "v"]


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_folder(spark).rstrip("/") + "/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_account_of_rows_left_out(spark, tmp_path):
    from pyspark.sql import Observation

    (tmp_path / "a.csv").write_text('id,name\n1,"a, b"\n2\n3,c,d\n4,\n')
    (tmp_path / "b.csv").write_text('id,name\n5,"x ""y"""\n6,"p,q",r,s\n')
    account = Observation("rows")
    rows = read_csv(spark, str(tmp_path), account=account)
    assert sorted(map(tuple, rows.collect())) == [("1", "a, b"), ("4", ""), ("5", 'x "y"')]
    assert account.get == {"kept": 3, "left_out": 3, "example": "2"}
    assert sorted(map(tuple, read_csv(spark, str(tmp_path)).collect())) == sorted(map(tuple, rows.collect()))
    cells = {(r.cells, r.kept, r.n_rows, r.no_first, r.example) for r in csv_cells(spark, str(tmp_path)).collect()}
    assert cells == {(2, True, 3, 0, None), (1, False, 1, 0, "2"), (3, False, 1, 0, "3,c,d"), (4, False, 1, 0, '6,"p,q",r,s')}
