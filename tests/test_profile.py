import pytest

from tessera.operators import features, profile

SAMPLE = """customer_id,first_name,gender,ip_address,phone,account_creation_date,total_spent
1,Ada,Female,10.0.7.1,555-0101,2020-03-01,120.50
2,Ben,Male,10.0.7.2,555-0102,2019-06-30,80.25
3,Cleo,Female,10.0.7.3,555-0103,2021-01-09,310.00
4,Dan,Male,10.0.7.4,555-0104,2022-12-24,45.75
5,Eva,Female,10.0.7.5,555-0105,2020-08-17,99.50
6,Finn,Male,10.0.7.6,555-0106,2018-02-11,200.00
7,Gia,Female,10.0.7.7,555-0107,2022-05-05,150.00
8,Hal,Male,10.0.7.8,555-0108,2021-10-31,60.00
9,Ida,Female,10.0.7.9,555-0109,2023-07-14,75.00
10,Jan,Male,10.0.7.10,555-0110,2019-09-02,59.00
"""


def text_frame(spark, values, rows=None):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id LONG, v STRING")


def profiled(df):
    return {r["name"]: r for r in profile.profile(df, "id", ["v"]).collect()}["v"]


def test_sample_file(spark, tmp_path):
    from tessera.sources.csv_files import read_csv

    (tmp_path / "customers.csv").write_text(SAMPLE)
    found = {r["name"]: r for r in profile.profile(read_csv(spark, str(tmp_path))).collect()}
    kinds = {n: r["type"] for n, r in found.items()}
    assert kinds == {
        "customer_id": "numeric", "first_name": "text", "gender": "categorical", "ip_address": "numeric",
        "phone": "numeric", "account_creation_date": "numeric", "total_spent": "numeric",
    }
    spent = found["total_spent"]["stats"]
    assert (spent["min"], spent["max"], spent["mean"]) == (45.75, 310.0, pytest.approx(120.0))
    assert found["phone"]["unique_count"] == 1 and found["phone"]["sample"] == ["555"]
    assert found["account_creation_date"]["sample"] == ["2020", "2019", "2021", "2022", "2018"]
    assert found["first_name"]["sample"] == ["Ada", "Ben", "Cleo", "Dan", "Eva"]
    assert found["gender"]["stats"] is None


def test_analysis_is_one_row(spark):
    df = spark.createDataFrame([(i, str(i), "xy"[i % 2]) for i in range(10)], "id LONG, v STRING, k STRING")
    (row,) = profile.analysis(df, "id").collect()
    assert (row["row_count"], row["column_count"]) == (10, 3)
    assert [(c["name"], c["type"], c["sample"][:2]) for c in row["columns"]] == [
        ("id", "numeric", ["0", "1"]), ("v", "numeric", ["0", "1"]), ("k", "categorical", ["x", "y"]),
    ]
    assert row["summary"] == "Dataset with 10 rows and 3 columns. 2 numeric features available for clustering."


def test_empty_column(spark):
    row = profiled(text_frame(spark, ["", None, " "]))
    assert (row["type"], row["null_count"], row["unique_count"], row["sample"], row["stats"]) == ("text", 3, 0, [], None)


def test_numeric_needs_more_than_nine_tenths(spark):
    # 20 distinct or fewer would make it categorical, so the texts are all different
    assert profiled(text_frame(spark, [str(i) for i in range(27)] + ["a", "b", "c"]))["type"] == "text"
    assert profiled(text_frame(spark, [str(i) for i in range(28)] + ["a", "b"]))["type"] == "numeric"


@pytest.mark.parametrize("distinct, rows, kind", [(20, 41, "categorical"), (20, 40, "text"), (21, 100, "text")])
def test_categorical_limits(spark, distinct, rows, kind):
    assert profiled(text_frame(spark, [f"v{i % distinct:02d}" for i in range(rows)]))["type"] == kind


def test_statistics_ignore_text_cells(spark):
    row = profiled(text_frame(spark, [str(i) for i in range(1, 20)] + ["x"]))
    assert row["type"] == "numeric" and row["stats"]["mean"] == 10.0
    assert row["stats"]["std_dev"] == pytest.approx(30.0 ** 0.5)
    assert row["unique_count"] == 20


def test_distinct_counts_equal_numbers_once(spark):
    row = profiled(text_frame(spark, ["5", "5.0", "5-LOW", "-0", "0"]))
    assert row["unique_count"] == 2 and row["sample"] == ["5", "0"]


def test_estimated_profile(spark):
    df = spark.range(5000).selectExpr("id", "concat('t', id % 7) AS few", "if(id % 4 = 0, '', cast(id AS string)) AS v")
    exact, estimated = (
        {r["name"]: r for r in profile.profile(df, columns=["id", "few", "v"], samples=False, exact=e).collect()} for e in (True, False)
    )
    for name in exact:
        assert exact[name]["type"] == estimated[name]["type"] and exact[name]["null_count"] == estimated[name]["null_count"]
        assert estimated[name]["unique_count"] == pytest.approx(exact[name]["unique_count"], rel=0.15)
    assert estimated["few"]["unique_count"] == 7 and exact["v"]["unique_count"] == 3750


def test_min_rows(spark):
    assert not profile.has_min_rows(spark.range(9)).first()[0]
    assert profile.has_min_rows(spark.range(10)).first()[0]


def test_preview_cuts_text_rows_and_columns(spark):
    df = spark.createDataFrame([(i, "x" * 30, *[0] * 8) for i in range(7)], ["id", "t", *"abcdefgh"])
    rows = profile.preview(df, ["id"]).collect()
    assert len(rows) == 5 and rows[0].asDict().keys() == {"id", "t", *"abcdef", "more"}
    assert rows[0]["t"] == "x" * 20 and rows[0]["more"] == "..."


def numeric_profile(spark, count):
    df = spark.createDataFrame([tuple(float(j) for j in range(count)) + ("t",)] * 2, [f"n{j}" for j in range(count)] + ["t"])
    return profile.profile(df, columns=df.columns, samples=False)


@pytest.mark.parametrize(
    "answer, columns, confidence",
    [
        (None, ["n0", "n1", "n2", "n3"], None),
        ("I would take n0", ["n0", "n1", "n2"], 0.6),
        ('{"columns": ["zz", "t"], "confidence": 0.9}', ["n0", "n1", "n2", "n3", "n4", "n5"], 0.7),
        ('{"columns": []}', ["n0", "n1", "n2", "n3", "n4", "n5"], 0.7),
        ('{"columns": ["n5", "zz", "n1", "n5"], "reasoning": "r"}', ["n5", "n1", "n5"], 0.8),
        ('{"columns": ["n1"], "confidence": 0.85}', ["n1"], 0.85),
    ],
)
def test_recommendation(spark, answer, columns, confidence):
    row = features.recommend_features(numeric_profile(spark, 7), answer).first()
    assert row["columns"] == columns and row["confidence"] == confidence


def test_recommendation_needs_a_numeric_column(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t STRING")
    with pytest.raises(Exception, match="none of the columns is numeric"):
        features.recommend_features(profile.profile(df, columns=["t"], samples=False)).collect()


def test_matrix_and_scaler(spark):
    df = spark.createDataFrame([(1, "1", "7"), (2, "3", "7"), (3, "x", "7")], "id INT, a STRING, c STRING")
    matrix = features.feature_matrix(df, ["a", "c"], ["id"])
    assert [r["a"] for r in matrix.orderBy("id").collect()] == [1.0, 3.0, 0.0]
    scaler = features.fit_scaler(matrix, ["a", "c"])
    assert scaler.stds[1] == 1.0
    scaled = scaler.transform(matrix, ["id"]).collect()
    assert {r["c"] for r in scaled} == {0.0}
    assert sum(r["a"] ** 2 for r in scaled) == pytest.approx(3.0)


def test_scaler_refuses_an_empty_table(spark):
    with pytest.raises(ValueError, match="empty"):
        features.fit_scaler(spark.createDataFrame([], "a DOUBLE"), ["a"])
