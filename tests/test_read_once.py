"""Jobs of several passes read stored rows, and no task holds a share of the rows that grows with them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from earshot import SkipPredictor
from earshot.operators import engagement as eng, features as fe, preparation as pr
from earshot.plans import hashpick, ranks
from earshot.sources import layout
from registry import features as rf, models as rm


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_skip_rows_are_made_once(mart):
    model, data = rm._trained_skip_model(mart, list(rm.sk.SKIP_FEATURES))
    assert "Join" not in plan_of(data) and "Join" not in plan_of(rm._fitted_rows(data))
    assert rm._fitted_rows(data).count() == data.count() - sum(-(-n // 5) for n in [data.count()])


def test_the_fit_and_its_folds_are_the_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2)) * [1, 20] + 3
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 3)))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, label int").persist()
    model = SkipPredictor(C=0.5)
    model.pipeline = model._fit(df, ["a", "b"], "label")
    z = (x - x.mean(0)) / x.std(0)
    weight = np.where(y == 1, 300 / y.sum(), 300 / (600 - y.sum()))
    beta, bias = model.linear.coefficients.toArray(), model.linear.intercept
    slope = weight * (1 / (1 + np.exp(-(z @ beta + bias))) - y)
    assert np.abs(0.5 * (z.T @ slope) + beta).max() < 1e-6 and abs(slope.sum()) < 1e-6
    folded = df.withColumn("_fold", F.col("id") % 3).persist()
    for k, part in enumerate(model._fit_folds(folded, ["a", "b"], "label", 3)):
        alone = model._fit(folded.where(F.col("_fold") != k), ["a", "b"], "label")
        np.testing.assert_allclose(part.stages[-1].coefficients.toArray(), alone.stages[-1].coefficients.toArray(), rtol=1e-7)
        assert part.stages[-1].intercept == pytest.approx(alone.stages[-1].intercept, abs=1e-9)


def test_a_missing_feature_is_an_error(rows):
    df = rows([(1, None, 0), (2, 1.0, 1), (3, 2.0, 0), (4, 3.0, 1)], "id int, a double, label int")
    with pytest.raises(ValueError, match="missing"):
        SkipPredictor()._fit(df, ["a"], "label")


def test_buckets_grow_with_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(layout, "_ROWS", 100)
    df = spark.range(1000).select((F.col("id") % 300).alias("user_id"), F.col("id").alias("timestamp"))
    table = layout.save_bucketed(df, "growing_buckets", str(tmp_path / "t"), buckets=2)
    assert table.count() == 1000
    buckets = [r.data_type for r in spark.sql("describe extended growing_buckets").collect() if r.col_name == "Num Buckets"]
    assert buckets == ["16"]


def test_forecast_rows_are_made_once(mart):
    assert "Aggregate" not in plan_of(rm._line(mart)) and "Aggregate" not in plan_of(rm._penalized(mart, "ridge", 200.0))


def test_copies_of_one_row_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(hashpick, "_CHUNK", 100)
    df = spark.range(0, 20_000, 1, 1).select(F.lit("a").alias("v"))
    marked = pr.mark_split(df, ["v"])
    by_task = marked.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in by_task) == 20_000 and len(by_task) > 1
    assert marked.where("is_test").count() == 4000


@pytest.mark.parametrize("query", [rf.skip_model_features_point_in_time])
def test_plays_are_derived_once(mart, query):
    assert "l_orderkey" not in plan_of(query(mart))


@pytest.mark.parametrize("name", ["dashboard_export", "dashboard_export_contents"])
def test_the_dashboard_reads_stored_plays(spark, monkeypatch, name):
    from earshot.sources import mart as source

    made = []
    monkeypatch.setattr(source, "stored", lambda df, what: made.append(what) or df.limit(0))
    entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert made == ["plays"]


@pytest.mark.parametrize("name", ["dashboard_export", "dashboard_export_contents"])
def test_the_dashboard_stores_the_columns_it_reads(spark, monkeypatch, name):
    from earshot.sources import mart as source

    made = []
    monkeypatch.setattr(source, "stored", lambda df, what: made.append(df.columns) or df.limit(0))
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert [sorted(columns) for columns in made] == [["context", "skipped", "timestamp", "track_id", "user_id"]]


def test_days_are_shuffled_once_as_one_row_per_user(spark, plays, rows):
    p = plays(*((u, f"2024-01-{d:02d} 10:00") for u in "ab" for d in range(1, 29)))
    users = rows([("a",), ("b",)], "user_id string").withColumn("signup_date", F.to_timestamp(F.lit("2024-01-01")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (eng.dau_mau(p), eng.retention_curve(users, p))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [re.findall(r"hashpartitioning\((\w+?)#[^()]*, \d+\)", plan) for plan in plans]
    assert not any("hashpartitioning(user_id#" in line and "month" in line for plan in plans for line in plan.splitlines())
    assert [d.count("user_id") for d in dealt] == [1, 3]  # plays; plays, users, and users again to be counted


def test_active_users_and_retention_by_hand(plays, rows):
    p = plays(("a", "2024-01-31 10:00"), ("a", "2024-01-31 23:59"), ("a", "2024-02-01 00:00"), ("a", "2025-01-31 10:00"), ("b", "2024-02-29 10:00"),
              (None, "2024-02-01 10:00"), (None, "2024-03-05 10:00"), ("b", None))
    got = {str(r.date): (r.dau, r.month, r.mau, r.dau_mau_ratio) for r in eng.dau_mau(p).collect()}
    assert got == {"2024-01-31": (1, "2024-01", 1, 1.0), "2024-02-01": (1, "2024-02", 2, 0.5), "2024-02-29": (1, "2024-02", 2, 0.5),
                   "2024-03-05": (0, "2024-03", 0, None), "2025-01-31": (1, "2025-01", 1, 1.0)}
    # a signed up twice, and is one user of a day all the same; c without a date counts among all.
    users = rows([("a", "2024-01-31"), ("a", "2024-01-30"), ("b", "2024-02-28"), ("c", None), (None, "2024-02-01")], "user_id string, s string")
    curve = eng.retention_curve(users.select("user_id", F.to_timestamp("s").alias("signup_date")), p, 2).collect()
    assert [(r.day, r.users, r.retention_rate) for r in curve] == [(0, 1, 1 / 3), (1, 2, 2 / 3), (2, 1, 1 / 3)]


def test_a_median_reads_its_column_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return float(v)
    df = spark.range(0, 3001, 1, 2).select(counted("id").alias("x"))
    assert ranks.exact_medians(df, ["x"], small=100) == {"x": 1500.0} and seen.value == 3001


def test_streaks_sort_no_days(plays):
    got = fe.streaks(plays(("u", "2024-01-30 10:00"), ("u", "2024-01-31 10:00"), ("u", "2024-02-01 10:00"), ("u", "2024-02-05 10:00"), ("v", "2024-02-05 10:00")))
    assert "Window" not in plan_of(got)
    assert {tuple(r) for r in got.collect()} == {("u", 1, 3, 2.0, 2, 4, 4 / 7), ("v", 1, 1, 1.0, 1, 1, 1.0)}


def test_tasks_of_a_query_take_bounded_shares(spark):
    entry.queries()["user_metrics_upsert"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
