import random
from datetime import date, timedelta

import pytest

from tessera.operators.snapshots import snapshot_features

SNAPSHOTS = ["2020-06-01", "2020-03-01", "2020-06-01", "2021-01-01"]


def brute_force(customers, rows, days, label_days):
    out = []
    for customer in customers:
        for text in sorted(set(SNAPSHOTS)):
            day = date.fromisoformat(text)
            mine = [((day - d).days, a) for c, d, a in rows if c == customer and d is not None]
            past = [(ago, a) for ago, a in mine if ago > 0]
            row = [customer, text, len(past), *(sum(ago <= w for ago, _ in past) for w in days)]
            row += [round(sum(a for _, a in past), 2), *(round(sum(a for ago, a in past if ago <= w), 2) for w in days)]
            out.append((*row, min((ago for ago, _ in past), default=None), int(not any(-label_days < ago <= 0 for ago, _ in mine))))
    return out


@pytest.mark.parametrize("label_days", [30, 90])
def test_features_and_labels_match_brute_force(spark, label_days):
    r = random.Random(4)
    rows = [(r.randrange(8), date(2019, 1, 1) + timedelta(r.randrange(900)), r.randrange(10_000) / 100) for _ in range(600)]
    rows += [(3, date(2020, 5, 31), 1.0), (3, date(2020, 6, 1), 2.0), (3, date(2020, 5, 2), 4.0), (None, date(2020, 1, 1), 9.0), (2, None, 9.0)]
    customers = list(range(10))
    frame = snapshot_features(
        spark.createDataFrame([(c,) for c in customers], "id INT"), "id", spark.createDataFrame(rows, "who INT, at DATE, paid DOUBLE"), "who", "at", "paid",
        SNAPSHOTS, (30, 365), label_days,
    )
    got = [(x[0], str(x[1]), *x[2:]) for x in map(tuple, frame.orderBy("customer_id", "snapshot").collect())]
    assert got == brute_force(customers, rows, (30, 365), label_days)


def test_activity_is_scanned_once(spark, tmp_path):
    spark.createDataFrame([(1, date(2020, 1, 1), 2.0, "x")], "who INT, at DATE, paid DOUBLE, other STRING").write.parquet(str(tmp_path / "paid"))
    paid = spark.read.parquet(str(tmp_path / "paid"))
    frame = snapshot_features(spark.createDataFrame([(1,)], "id INT"), "id", paid, "who", "at", "paid", [f"2020-{m:02}-01" for m in range(1, 13)])
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "other" not in plan.split("parquet")[0].splitlines()[-2]
    with pytest.raises(ValueError):
        snapshot_features(paid, "who", paid, "who", "at", "paid", [])
