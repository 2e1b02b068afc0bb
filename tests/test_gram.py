"""Moments by fold, and fits and scores from them, against fits on the rows."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.models import gram
from earshot.models.duration import SessionForecaster

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4)) * [1, 50, 0.01, 1] + [1e6, 0, 3, 0]
    x[:, 3] = x[:, 1] * 2 + rng.normal(size=400)  # nearly collinear
    y = x[:, 0] - 0.1 * x[:, 1] + 200 * x[:, 2] + rng.normal(size=400)
    return x, y, np.arange(400) % 5


def moments(x, y):
    both = np.column_stack([x, y])
    return gram.Moments(len(both), both.mean(axis=0), (both - both.mean(axis=0)).T @ (both - both.mean(axis=0)))


def test_moments_by_fold(spark, data):
    x, y, fold = data
    df = spark.createDataFrame([(*map(float, r), float(t), int(f)) for r, t, f in zip(x, y, fold)], "a double, b double, c double, d double, y double, f int")
    got = gram.moments_by(df.repartition(7), NAMES, "y", "f")
    for k in range(5):
        want = moments(x[fold == k], y[fold == k])
        assert got[k].n == want.n
        np.testing.assert_allclose(got[k].mean, want.mean, rtol=1e-12)
        np.testing.assert_allclose(got[k].spread, want.spread, rtol=1e-8, atol=1e-6)
    whole, want = reduce(gram.Moments.__add__, got.values()), moments(x, y)
    np.testing.assert_allclose(whole.spread, want.spread, rtol=1e-8, atol=1e-6)


def test_missing_values_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (None, 1.0, 0), (3.0, float("nan"), 1)], "a double, y double, f int")
    with pytest.raises(ValueError, match="'a'"):
        gram.moments_by(df.where("f = 0"), ["a"], "y", "f")
    with pytest.raises(ValueError, match="'y'"):
        gram.moments_by(df.where("f = 1"), ["a"], "y", "f")


def plain(x, y, kind, alpha):
    """Slopes by the rows: normal equations on scaled features."""
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    lift = alpha if kind == "ridge" else 0.0
    return np.linalg.solve(z.T @ z + lift * np.eye(z.shape[1]), z.T @ (y - y.mean())) / x.std(axis=0)


@pytest.mark.parametrize("kind", ["linear", "ridge"])
def test_held_out_scores(data, kind):
    x, y, fold = data
    got = gram.held_out_r2({k: moments(x[fold == k], y[fold == k]) for k in range(5)}, kind, 2.0)
    for k in range(5):
        train, test = fold != k, fold == k
        slopes = plain(x[train], y[train], kind, 2.0)
        error = y[test] - y[train].mean() - (x[test] - x[train].mean(axis=0)) @ slopes
        assert got[k] == pytest.approx(1 - (error ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum(), abs=1e-9)


@pytest.mark.parametrize("alpha", [0.01, 0.5, 3.0, 1e9])
def test_lasso_is_an_optimum(data, alpha):
    x, y, _ = data
    line = gram.fit(moments(x, y), "lasso", alpha)
    w = line.slopes * x.std(axis=0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    slope = z.T @ (y - y.mean() - z @ w) / len(y)
    assert (np.abs(slope) <= alpha * (1 + 1e-9) + 1e-9).all()
    np.testing.assert_allclose(slope[w != 0], alpha * np.sign(w[w != 0]), rtol=1e-6)
    assert alpha < 1e9 or (w == 0).all()


def test_odd_folds(data):
    x, y, _ = data
    flat = np.column_stack([x[:, :2], np.ones(len(x))])
    line = gram.fit(moments(flat, y), "ridge", 1.0)
    assert line.slopes[2] == 0
    one = moments(x, y)
    assert gram.held_out_r2({0: one}, "ridge", 1.0) == {0: None}
    assert line.r2(moments(flat[:50], np.full(50, 3.0))) is None


def test_cross_validation_scans_once(spark, data, tmp_path):
    x, y, _ = data
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y double").write.parquet(path)
    df = spark.read.parquet(path)
    seen = []

    def counting(self, rows, *more):
        seen.append(str(rows._jdf.queryExecution().optimizedPlan()).count("Relation ["))
        return original(rows, *more)
    original = gram.moments_by
    gram.moments_by = lambda *a: counting(None, *a)
    try:
        jobs = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup("cv", "cross validation")
        got = SessionForecaster("ridge").cross_validate(df, NAMES, "y", cv=4, key=["id"])
        used = len(jobs.getJobIdsForGroup("cv"))
    finally:
        gram.moments_by = original
        spark.sparkContext.setJobGroup("", "")
    assert seen == [1] and used <= 2  # one scan; with adaptive plans its shuffle is a job of its own
    folds = SessionForecaster("ridge")
    marked = df.withColumn("f", folds._fold(["id"], 4)).toPandas()
    for k in range(4):
        train, test = marked[marked.f != k], marked[marked.f == k]
        slopes = plain(train[NAMES].to_numpy(), train.y.to_numpy(), "ridge", 1.0)
        error = test.y - train.y.mean() - (test[NAMES].to_numpy() - train[NAMES].to_numpy().mean(axis=0)) @ slopes
        assert got["cv_scores"][k] == pytest.approx(1 - (error ** 2).sum() / ((test.y - test.y.mean()) ** 2).sum(), abs=1e-9)
    assert got["cv_r2_mean"] == pytest.approx(np.mean(got["cv_scores"]))
