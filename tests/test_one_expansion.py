"""User features from three passes over the plays, equal to the groups by themselves."""

import re

import pytest
from pyspark.sql import functions as F

from earshot.operators import features as fe


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def tables(spark, mart, tmp_path_factory):
    """Plays, users and tracks as stored tables."""
    out = {}
    for name in ("sessions", "users", "tracks"):
        path = str(tmp_path_factory.mktemp("star") / name)
        getattr(mart, name).write.parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def test_three_scans_and_few_shuffles(spark, tables):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        plan = final_plan(fe.user_features(tables["sessions"], tables["users"], tables["tracks"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before["spark.sql.autoBroadcastJoinThreshold"])
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    plays = [line for line in plan.split("\n") if "FileScan" in line and "listen_duration_ms" in line or "FileScan" in line and "session_id" in line or "FileScan" in line and "timestamp" in line and "signup" not in line]
    assert len(plays) == 3
    assert len(re.findall(r"(?<!Reused)Exchange ", plan)) <= 18


def test_the_same_as_the_groups(tables):
    wide = {r.user_id: r.asDict() for r in fe.user_features(tables["sessions"], tables["users"], tables["tracks"]).collect()}
    plays = fe.with_tracks(tables["sessions"], tables["tracks"])
    for group in (fe.streaks(tables["sessions"]), fe.genre_diversity(plays), fe.listening(tables["sessions"]), fe.engagement(tables["sessions"]),
                  fe.temporal(tables["sessions"]), fe.audio_preferences(plays), fe.playlist_behavior(tables["sessions"])):
        for row in group.collect():
            for name, value in row.asDict().items():
                assert wide[row.user_id][name] == pytest.approx(value if value is not None else 0), name


def test_users_with_gaps(spark, rows, plays):
    p = plays(("a", "2024-01-01 10:00"), ("a", "2024-01-02 10:00"), ("a", "2024-01-05 10:00"), ("b", "2024-01-03 10:00"), (None, "2024-02-01 10:00"))
    p = p.withColumn("timestamp", F.when(~F.col("user_id").eqNullSafe("b"), F.col("timestamp"))).withColumn(
        "track_id", F.when(~F.col("user_id").eqNullSafe("b"), F.col("track_id"))).withColumn("session_id", F.when(~F.col("user_id").eqNullSafe("b"), F.col("session_id")))
    tracks = rows([("t1", None, 0.5, 0.5, 0.5, 0.5, 0.5)], "track_id string, genre string, tempo double, energy double, danceability double, valence double, acousticness double")
    users = rows([("a", "free", "DE", None), ("c", "free", "US", None)], "user_id string, tier string, country string, age_group string")
    got = {r.user_id: r for r in fe.user_features(p, users, tracks).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.current_streak, a.max_streak, a.streak_count, a.active_days, a.active_days_ratio) == (1, 2, 2, 3, 0.6)
    assert (a.genre_count, a.unique_tracks, a.session_count, a.country_frequency) == (0, 1, 3, 1.0)
    assert a.days_since_last_listen == 27  # counted to the last play of all, users unknown included
    assert (b.active_days, b.streak_count, b.unique_tracks, b.session_count, b.total_events, b.country_frequency) == (0, 0, 0, 0, 0, 0.1)
