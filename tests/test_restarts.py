import hashlib
import math

import numpy as np
import pytest

from tessera.operators import restarts

rng = np.random.default_rng(11)
MIDDLES = rng.normal(size=(4, 3)) * 6
DATA = np.vstack([m + rng.normal(size=(40, 3)) for m in MIDDLES])
FEATURES = ["f0", "f 1", "f2"]


def frame(spark, data, parts=3):
    rows = [(i, *map(float, row)) for i, row in enumerate(data)]
    names = ", ".join(f"`{f}` DOUBLE" for f in FEATURES[: data.shape[1]])
    return spark.createDataFrame(rows, f"id LONG, {names}").repartition(parts)


def number(row_id, seed, step):
    digest = hashlib.md5(f"{row_id}:{seed}:{step}".encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / (1 << 52)


def drawn(data, k, seed):
    centers = []
    for step in range(k):
        weights = np.min([((data - c) ** 2).sum(axis=1) for c in centers], axis=0) if centers else np.ones(len(data))
        u = [number(i, seed, step) for i in range(len(data))]
        race = [(w / -math.log(x), x, tuple(row)) for w, x, row in zip(weights, u, data.tolist())]
        centers.append(np.array(max(race)[2]))
    return np.array(centers)


def lloyd(data, centers, rounds=100):
    labels = None
    for number in range(1, rounds + 1):
        squares = ((data[:, None] - centers[None]) ** 2).sum(axis=2)
        new, inertia = squares.argmin(axis=1), squares.min(axis=1).sum()
        if labels is not None and (new == labels).all():
            return centers, inertia, number, True
        labels = new
        centers = np.array([data[labels == c].mean(axis=0) if (labels == c).any() else centers[c] for c in range(len(centers))])
    return centers, inertia, rounds, False


@pytest.mark.parametrize("parts", [1, 5])
def test_starts_are_those_of_the_race(spark, parts):
    starts = restarts.draw_starts(frame(spark, DATA, parts), "id", FEATURES, 4, (42, 7))
    for start, seed in zip(starts, (42, 7)):
        assert [i for i, _ in start] == [0, 1, 2, 3]
        assert np.array([c for _, c in start]) == pytest.approx(drawn(DATA, 4, seed))


def test_rows_are_drawn_in_proportion_to_their_squared_distance(spark):
    """With a first centre at either of two heaps, the far heap is nearly always next."""
    data = np.array([[0.0]] * 50 + [[1.0]] * 50 + [[20.0]])
    starts = restarts.draw_starts(frame(spark, data), "id", ["f0"], 2, tuple(range(200)))
    firsts = [start[0][1][0] for start in starts]
    # a row is first once in 101; the lone far row carries 361 to 400 of the 411 to 450 shares of the next draw
    assert 60 <= firsts.count(0.0) <= 140
    seconds = [start[1][1][0] for start in starts if start[0][1][0] != 20.0]
    assert 0.8 < seconds.count(20.0) / len(seconds) < 0.98


def test_fewer_points_than_centers(spark):
    data = np.array([[0.0, 0.0]] * 3 + [[1.0, 1.0]])
    start = restarts.draw_starts(frame(spark, data), "id", FEATURES[:2], 4, (1,))[0]
    assert {tuple(c) for _, c in start} == {(0.0, 0.0), (1.0, 1.0)}
    fit = restarts.fit_all(frame(spark, data), "id", FEATURES[:2], [start])[0]
    assert fit.settled and fit.inertia == 0.0
    with pytest.raises(ValueError, match="no rows"):
        restarts.draw_starts(frame(spark, data).limit(0), "id", FEATURES[:2], 2)


def test_all_starts_end_as_when_fitted_alone(spark):
    points = frame(spark, DATA)
    starts = [list(enumerate(drawn(DATA, 4, seed).tolist())) for seed in range(5)] + [[(0, [0.0] * 3), (1, [500.0] * 3)]]
    fits = restarts.fit_all(points, "id", FEATURES, starts)
    for fit, start in zip(fits, starts):
        centers, inertia, rounds, settled = lloyd(DATA, np.array([c for _, c in start]))
        assert (fit.rounds, fit.settled) == (rounds, settled) and settled
        assert np.array([c for _, c in fit.centers]) == pytest.approx(centers) and fit.inertia == pytest.approx(inertia)
    assert len({fit.rounds for fit in fits}) > 1
    assert fits[-1].centers[1] == (1, [500.0] * 3)  # nobody chose it
    assert restarts.best_of(fits).inertia == min(fit.inertia for fit in fits)


def test_rounds_end_a_fit(spark):
    start = list(enumerate(drawn(DATA, 4, 3).tolist()))
    for rounds in (1, 2):
        fit = restarts.fit_all(frame(spark, DATA), "id", FEATURES, [start], rounds)[0]
        centers, inertia, _, _ = lloyd(DATA, np.array([c for _, c in start]), rounds)
        assert not fit.settled and np.array([c for _, c in fit.centers]) == pytest.approx(centers) and fit.inertia == pytest.approx(inertia)


def test_equal_inertias_go_to_the_earliest_start():
    fits = [restarts.Fit(i, [], inertia, 1, True) for i, inertia in enumerate([5.0, 3.0 * (1 + 1e-12), 3.0, 4.0])]
    assert restarts.best_of(fits).start == 1


def test_one_job_per_round_whatever_the_number_of_starts(spark):
    points = frame(spark, DATA).checkpoint()
    starts = [list(enumerate(drawn(DATA, 4, seed).tolist())) for seed in range(6)]
    context, name = spark.sparkContext, "spark.sql.adaptive.enabled"
    spark.conf.set(name, "false")  # else every stage is a job
    context.setJobGroup("rounds", "rounds")
    try:
        fits = restarts.fit_all(points, "id", FEATURES, starts)
    finally:
        spark.conf.set(name, "true")
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("rounds")) == max(fit.rounds for fit in fits)


def test_rows_of_one_id_are_told_apart_by_their_labels(spark):
    """Two rows of one id that both change sides must not look as if nothing had moved."""
    rows = [(1, 0.0), (1, 0.2), (2, 4.0), (2, 4.2), (3, 10.0), (3, 11.0)]
    points = spark.createDataFrame(rows, "id LONG, f0 DOUBLE")
    data = np.array([[x] for _, x in rows])
    fit = restarts.fit_all(points, "id", ["f0"], [[(0, [0.0]), (1, [0.2])]])[0]
    centers, inertia, rounds, _ = lloyd(data, np.array([[0.0], [0.2]]))
    assert np.array([c for _, c in fit.centers]) == pytest.approx(centers) and fit.inertia == pytest.approx(inertia)


def test_too_many_centers_are_refused(spark):
    with pytest.raises(ValueError, match="more than"):
        restarts.draw_starts(frame(spark, DATA), "id", FEATURES, 300, range(5))


@pytest.mark.parametrize("bad", [np.nan, np.inf])
def test_rows_without_numbers_only_change_their_own_centre(bad):
    x, hashes = rng.normal(size=(3, 500)), rng.integers(0, 1 << 24, (3, 500)).astype(float)
    x[1, 7] = bad
    centers = np.array([[0.0, 0, 0], [1, 1, 1], [1, 1, 1], [-1, 0, 1]])
    with np.errstate(invalid="ignore"):
        squared, chosen = restarts._nearest(x, centers)
        totals = restarts._Totals(4, 3)
        totals.add(np.vstack([x, hashes]), squared, chosen)
        label = np.square(x[None] - centers[:, :, None]).sum(axis=1).argmin(axis=0)
    assert (chosen.argmax(axis=0) == label).all() and (chosen.sum(axis=0) == 1).all() and label[7] == 0
    for i in range(4):
        rows = label == i
        assert totals.size[i] == rows.sum() and (totals.hashes[i] == hashes[:, rows].sum(axis=1)).all()
        np.testing.assert_allclose(totals.sums[i], x[:, rows].sum(axis=1))
    assert np.isfinite(totals.squared[1:]).all() and totals.size[2] == 0


def test_rounds_run_in_few_tasks_over_packed_rows(spark):
    """However many parts the points have, a round has no more tasks than keep the cores busy."""
    start = list(enumerate(drawn(DATA, 4, 3).tolist()))
    points, context = frame(spark, DATA, 40).checkpoint(), spark.sparkContext
    context.setJobGroup("few tasks", "few tasks")
    try:
        restarts.fit_all(points, "id", FEATURES, [start], 3)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = [context.statusTracker().getJobInfo(j).stageIds for j in context.statusTracker().getJobIdsForGroup("few tasks")]
    tasks = [i.numTasks for s in stages for i in map(context.statusTracker().getStageInfo, s) if i]
    assert tasks and max(tasks) <= 2 * context.defaultParallelism
