import numpy as np
import pytest

from tessera.operators import cells, silhouette
from test_segmentation import brute_silhouette, points


def sheets(rng, rows):
    """A whole number, an amount that grows with it, the one divided by the other, and days."""
    count = rng.integers(1, 20, rows).astype(float)
    spend = count * 100 + rng.normal(0, 30, rows) * np.sqrt(count)
    data = np.column_stack([count, spend, np.round(spend / count, 2), rng.integers(0, 300, rows)])
    return (data - data.mean(axis=0)) / data.std(axis=0)


SHAPES = {
    "sheets": lambda rng: sheets(rng, 4000),
    "four dimensions": lambda rng: rng.normal(size=(3000, 4)),
    "a line": lambda rng: np.outer(rng.normal(size=3000), [1.0, -2.0, 0.5]),
    "a plane far away": lambda rng: rng.normal(size=(3000, 2)) @ rng.normal(size=(2, 3)) + 1e4,
    "heaps and an outlier": lambda rng: np.vstack([rng.normal(size=(40, 2)).repeat(75, 0) * 50 + rng.normal(0, 1e-4, (3000, 2)), [[1e7, 0]]]),
    "equal places": lambda rng: np.repeat(rng.normal(size=(5, 2)), 400, axis=0),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_sums_by_cells_are_those_of_all_pairs(shape):
    rng = np.random.default_rng(4)
    data = SHAPES[shape](rng)
    label, weight = rng.integers(0, 3, len(data)), rng.integers(1, 4, len(data))
    label[data[:, 0] > np.median(data[:, 0])] = 1
    weights = np.zeros((len(data), 4))  # nobody is in the last cluster
    weights[np.arange(len(data)), label] = weight
    half = len(data) // 3
    whole = cells.Block(data, weights, data.mean(axis=0))
    cells.meet(whole, whole)
    one, other = (cells.Block(data[part], weights[part], data[:half].mean(axis=0)) for part in (slice(half), slice(half, None)))
    cells.meet(one, other)
    want = np.zeros_like(weights)
    for i in range(0, len(data), 100):
        want[i : i + 100] = np.sqrt(np.square(data[i : i + 100, None] - data[None]).sum(axis=2)) @ weights
    np.testing.assert_allclose(whole.result(), want, rtol=1e-8, atol=1e-7 * (shape == "equal places"))
    apart = np.sqrt(np.square(data[:half, None] - data[None, half:]).sum(axis=2))
    np.testing.assert_allclose(one.result(), apart @ weights[half:], rtol=1e-8)
    np.testing.assert_allclose(other.result(), apart.T @ weights[:half], rtol=1e-8)


def test_distances_grow_much_slower_than_the_pairs(monkeypatch):
    rng, plain, made = np.random.default_rng(5), cells._distances, []

    def counted(*args):
        made.append(plain(*args).size)
        return plain(*args)

    monkeypatch.setattr(cells, "_distances", counted)
    counts = {}
    for rows in (8000, 32000):
        made.clear()
        data = rng.uniform(size=(rows, 2))
        block = cells.Block(data, np.ones((rows, 1)), data.mean(axis=0))
        cells.meet(block, block)
        counts[rows] = sum(made)
    assert counts[32000] < 32000**2 / 2 / 3 and counts[32000] < 7 * counts[8000]  # 16 times the pairs


@pytest.mark.parametrize("placed", [100_000, 150])
def test_silhouette_by_cells_is_that_of_all_points(spark, monkeypatch, placed):
    rng = np.random.default_rng(6)
    data = np.vstack([sheets(rng, 1200), np.full((30, 4), 0.25), [[40.0, 0, 0, 0]]])
    data[:, 3] = 2.0  # one side without length
    labels = np.where(data[:, 1] > 0, 1, 0) + np.where(data[:, 0] > 1, 2, 0)
    labels[3] = 9
    monkeypatch.setattr(silhouette, "MANY", 1000)
    monkeypatch.setattr(silhouette, "PLACED", placed)
    monkeypatch.setattr(silhouette, "CELLS", 1)
    got = silhouette.silhouette(points(spark, data, labels), "label", ["f0", "f1", "f2", "f3"]).first()
    assert got["points"] == 1231 and got[0] == pytest.approx(brute_silhouette(data, labels), abs=1e-9)


def test_points_without_numbers_are_not_met_by_cells(spark, monkeypatch):
    monkeypatch.setattr(silhouette, "MANY", 1)
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.5, 2.0), (1, 9.0, 9.0), (1, None, 9.0), (2, 5.0, 5.0)], "label INT, f0 DOUBLE, f1 DOUBLE")
    assert tuple(silhouette.silhouette(df, "label", ["f0", "f1"]).first()) == (0.0, 5)
    one = df.where("f0 is not null").withColumn("label", df["f0"] * 0)
    assert silhouette.silhouette(one, "label", ["f0", "f1"]).first()[0] == 0.0
