"""Everything in one go: features, models, analyses, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame

from earshot.models.duration import SessionForecaster
from earshot.models.skip import SkipPredictor
from earshot.operators import cohorts, engagement, experiments, features, funnels, skip_features
from earshot.sources import writers

DURATION_INPUTS = ["session_count", "duration_std", "skip_rate", "avg_hour"]


def train_models(sessions: DataFrame, tracks: DataFrame, key: list[str] | None = None):
    """The skip model on all plays and the ridge model on all users, both fitted."""
    skip = SkipPredictor(C=1.0, class_weight="balanced")
    skip.train(skip_features.skip_features(sessions, tracks), skip_features.SKIP_FEATURES, key=key)
    duration = SessionForecaster(model_type="ridge", n_features=15)
    duration.train(features.duration_features(sessions), DURATION_INPUTS, key=["user_id"])
    return skip, duration


#: Columns that tell plays apart.
PLAY_KEY = ("session_id", "user_id", "track_id")


def full_run(tables: dict[str, DataFrame], directory: str, key: tuple[str, ...] = PLAY_KEY) -> dict:
    """Compute all results of a data set and write them under ``directory``.

    Needs ``users``, ``tracks`` and ``sessions``; test results are analysed if
    ``ab_test_assignments`` and ``ab_test_results`` are there. ``key`` names the
    columns that tell plays apart, by which they are dealt into training and
    validation. Returns what was fitted and the frames behind the written results.
    """
    users, tracks, sessions = (tables[n] for n in ("users", "tracks", "sessions"))
    spark = sessions.sparkSession
    writers.save_tables({"user_features": features.user_features(sessions, users, tracks)}, directory)
    skip, duration = train_models(sessions, tracks, list(key))

    progress = funnels.playlist_progress(sessions, playlist_tracks=tables.get("playlist_tracks"))
    counts = funnels.completion_counts(progress)
    long_form = cohorts.retention(users, sessions, "monthly", 6)
    results = {
        "skip_metrics": spark.createDataFrame([skip.metrics]),
        "duration_metrics": spark.createDataFrame([duration.metrics]),
        "retention_summary": cohorts.retention_summary(long_form),
        "playlist_metrics": funnels.completion_metrics(progress),
        "activation_metrics": funnels.activation_rates(users, sessions),
        "recommendations": funnels.recommendations(counts, list(funnels.COMPLETION_STAGES)),
    }
    if {"ab_test_assignments", "ab_test_results"} <= set(tables):
        results["ab_tests"] = experiments.analyze(tables["ab_test_assignments"], tables["ab_test_results"])
    writers.save_results(results, f"{directory}/results")
    writers.export_reports({"retention_data": long_form,
                            "retention_matrix": cohorts.retention_matrix(long_form, 6),
                            "cohort_engagement": cohorts.cohort_engagement(users, sessions)},
                           f"{directory}/cohorts")
    writers.export_dashboard(engagement.dau_mau(sessions), engagement.skip_rates(sessions, tracks),
                             engagement.retention_curve(users, sessions), f"{directory}/dashboards")
    return {"skip_predictor": skip, "session_forecaster": duration, **results}
