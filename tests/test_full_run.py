"""The whole run over the given tables: what it fits, writes and returns."""

import json

import pytest

from earshot.models.duration import SessionForecaster
from earshot.models.skip import SkipPredictor
from earshot.operators import cohorts, engagement, features
from earshot.plans.full_run import full_run


@pytest.fixture(scope="module")
def run(mart, tmp_path_factory):
    directory = str(tmp_path_factory.mktemp("run"))
    tables = {"users": mart.users, "tracks": mart.tracks, "sessions": mart.sessions,
              "ab_test_assignments": mart.assignments, "ab_test_results": mart.results}
    return directory, full_run(tables, directory)


def test_models_are_fitted(run):
    _, out = run
    assert isinstance(out["skip_predictor"], SkipPredictor) and out["skip_predictor"].is_fitted
    assert isinstance(out["session_forecaster"], SessionForecaster) and out["session_forecaster"].is_fitted
    metrics = out["skip_metrics"].head().asDict()
    assert metrics == out["skip_predictor"].metrics and 0.5 < metrics["train_auc"] <= 1


def test_features_are_written(spark, mart, run):
    directory, _ = run
    stored = spark.read.parquet(f"{directory}/user_features")
    assert stored.count() == mart.sessions.select("user_id").distinct().count()
    assert {n for names in features.FEATURE_GROUPS.values() for n in names} <= set(stored.columns)


def test_results_are_written_as_json(spark, run):
    directory, out = run
    for name in ("skip_metrics", "duration_metrics", "retention_summary", "playlist_metrics", "activation_metrics", "recommendations", "ab_tests"):
        lines = [json.loads(r.value) for r in spark.read.text(f"{directory}/results/{name}").collect()]
        assert len(lines) == out[name].count(), name
    tests = [json.loads(r.value) for r in spark.read.text(f"{directory}/results/ab_tests").collect()]
    assert tests[0]["test_name"] == "recs" and 0 <= tests[0]["p_value"] <= 1


def test_reports_are_written_as_csv(spark, mart, run):
    directory, _ = run

    def read(name):
        return spark.read.option("header", True).csv(f"{directory}/{name}")
    assert read("cohorts/retention_data").count() == cohorts.retention(mart.users, mart.sessions, "monthly", 6).count()
    assert {r.date: (r.dau, r.mau) for r in read("dashboards/dau_mau_metrics").collect()} == {
        str(r.date): (str(r.dau), str(r.mau)) for r in engagement.dau_mau(mart.sessions).collect()}
    assert read("dashboards/retention_curve").count() == 31
    assert read("dashboards/skip_rates_by_hour").count() == len(engagement.skip_rates(mart.sessions, mart.tracks)["by_hour"].collect())
