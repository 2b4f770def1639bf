import json

from pyspark.sql import functions as F

from tessera.operators import insights, kpi, quality


def clusters(spark):
    return spark.createDataFrame(
        [(0, 30, [1.0, 2.0], 0.25), (1, 10, [0.5, -1.0], 1.0)], "id INT, size LONG, centroid ARRAY<DOUBLE>, avg_distance DOUBLE"
    )


def described(df):
    return {r["id"]: r for r in df.collect()}


def test_defaults(spark):
    rows = described(insights.describe_segments(clusters(spark)))
    assert rows[0]["name"] == "Segment 1" and rows[0]["characteristics"] == ["Customer segment identified"]
    assert rows[1]["business_description"] == "A segment of 10 customers with distinct behavioral patterns."
    assert rows[1]["recommended_actions"] == ["Analyze segment", "Develop campaigns"]
    assert rows[0]["metrics"]["cohesion"] == 0.8 and rows[1]["metrics"]["cohesion"] == 0.5


def test_first_interpretation_wins_and_fields_default_alone(spark):
    answer = json.dumps({"clusters": [
        {"id": 1, "name": "Loyal", "characteristics": ["a", "b"]},
        {"id": 1, "name": "Late"},
        {"id": 7, "name": "Nobody"},
    ]})
    frame = clusters(spark)
    rows = described(insights.describe_segments(frame, insights.read_answer(spark, answer, frame)))
    assert rows.keys() == {0, 1} and rows[1]["name"] == "Loyal" and rows[1]["characteristics"] == ["a", "b"]
    assert rows[1]["recommended_actions"] == ["Analyze segment", "Develop campaigns"] and rows[0]["name"] == "Segment 1"


def test_unreadable_answer(spark):
    frame = clusters(spark)
    rows = described(insights.describe_segments(frame, insights.read_answer(spark, "sorry, no", frame)))
    assert rows[0]["business_description"] == "A segment of 30 customers"
    assert rows[0]["recommended_actions"] == ["Analyze further"]


def test_strategy_of_known_and_unknown_names(spark):
    df = spark.createDataFrame([(1, "Dormant Users"), (2, "Unheard Of"), (3, None)], "id INT, segment STRING")
    found = {r["id"]: r for r in insights.strategy_lookup(df, "segment").collect()}
    assert found[1]["headline"] == "Reactivation Campaign" and len(found[1]["subject_lines"]) == 3
    assert found[2]["headline"] == found[3]["headline"] == "Nurture and Educate"
    assert found[2]["segment"] == "Unheard Of"


def test_export(spark, tmp_path):
    importance = spark.createDataFrame([(0, "a", 0.5), (1, "b", 1.0), (2, "c", 0.5)], "position INT, feature STRING, importance DOUBLE")
    exported = insights.export_results(insights.describe_segments(clusters(spark)), importance, ["a", "b", "c"], 0.4)
    exported.write.json(str(tmp_path / "out"))
    (line,) = spark.read.text(str(tmp_path / "out")).collect()
    result = json.loads(line[0])
    assert result["summary"] == {"total_customers": 40, "num_clusters": 2, "silhouette_score": 0.4, "features": ["a", "b", "c"]}
    assert [c["percentage"] for c in result["clusters"]] == ["75.0%", "25.0%"]
    assert [f["feature"] for f in result["feature_importance"]] == ["b", "a", "c"]


def test_context(spark):
    row = quality.cluster_context(clusters(spark), ["x", "y"], 40).orderBy("id").first()
    assert row["percent"] == 75.0 and row["centroid_values"] == {"x": 1.0, "y": 2.0} and row["cohesion"] == 0.25


def test_kpis(spark):
    table = spark.createDataFrame(
        [("High-Value Loyalists", 12450, 4850.0, "low"), ("At-Risk Champions", 8320, 3200.0, "high"), ("New Potential", 15680, 1200.0, "medium"),
         ("Casual Browsers", 24100, 450.0, "medium"), ("Dormant Users", 6780, 280.0, "high")],
        "segment STRING, customers LONG, avg_ltv DOUBLE, churn_risk STRING",
    )
    assert tuple(kpi.segment_kpis(table).first()) == (67330, 5, 1996.0, 15100)


def test_risk_levels(spark):
    shares = spark.createDataFrame([(0.3,), (0.34,), (0.66,), (0.67,)], "s DOUBLE")
    assert [r[0] for r in shares.select(kpi.risk_level(F.col("s"))).collect()] == ["low", "medium", "medium", "high"]
