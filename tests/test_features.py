import pytest
from pyspark.sql import functions as F

from earshot import FeatureEngineer, create_session_features, create_skip_prediction_features
from earshot.operators import features as fe, sessionize as sz, skip_features as sk


def of(df, user="u"):
    return df.where(F.col("user_id") == user).head()


def tracks(rows, *items):
    data = [(t, g, 120.0, e, 0.5, 0.5, a, 0.1, 0.1, 0.1, -8.0) for t, g, e, a in items]
    return rows(data, "track_id string, genre string, tempo double, energy double, danceability double, valence double, "
                      "acousticness double, instrumentalness double, liveness double, speechiness double, loudness double")


def test_streaks(plays):
    got = of(fe.streaks(plays(*(("u", f"2024-01-{d:02d} 10:00") for d in (1, 2, 3, 5, 6, 10, 10)))))
    assert (got.current_streak, got.max_streak, got.avg_streak, got.streak_count, got.active_days) == (1, 3, 2.0, 3, 6)
    assert got.active_days_ratio == pytest.approx(0.6)


def test_streak_over_new_year(plays):
    got = of(fe.streaks(plays(("u", "2023-12-31 23:00"), ("u", "2024-01-01 00:10"))))
    assert got.max_streak == got.current_streak == 2


def test_parts_of_day(plays):
    got = of(fe.temporal(plays(*(("u", f"2024-01-01 {h:02d}:00") for h in (0, 6, 7, 12, 13, 18, 19, 23)))))
    assert [got[f"{p}_ratio"] for p in ("night", "morning", "afternoon", "evening")] == [0.25] * 4
    assert got.hour_entropy == pytest.approx(3.0) and got.weekend_ratio == 0.0


def test_peak_hour_tie_goes_to_the_earlier(plays):
    assert of(fe.temporal(plays(*(("u", f"2024-01-01 {h:02d}:00") for h in (5, 3, 3, 5, 9))))).peak_hour == 3


def test_genre_diversity(rows, plays):
    p = plays(*(("u", "2024-01-01 10:00", {"track_id": t}) for t in ["a"] * 30 + ["b"]),
              ("v", "2024-01-01 10:00", {"track_id": "a"}))
    joined = fe.with_tracks(p, tracks(rows, ("a", "pop", 0.5, 0.1), ("b", "rock", 0.5, 0.1)))
    got, single = of(fe.genre_diversity(joined)), of(fe.genre_diversity(joined), "v")
    assert got.genre_count == 2 and got.genre_exploration_rate == 0.5
    assert got.genre_concentration == pytest.approx((30 / 31) ** 2 + (1 / 31) ** 2)
    assert (single.genre_entropy, single.genre_concentration, single.genre_exploration_rate) == (0.0, 1.0, 0.0)


def test_all_features_of_odd_users(rows, plays):
    """One play, no known genre, no user row."""
    p = plays(("u", "2024-01-01 10:00", {"track_id": "x", "context": "radio"}), ("w", "2024-01-05 10:00"))
    users = rows([("w", "premium", "DE", "55+")], "user_id string, tier string, country string, age_group string")
    got = of(fe.user_features(p, users, tracks(rows, ("t1", None, 0.9, 0.1))))
    assert got.std_listen_duration_ms == 0 and got.genre_entropy == 0 and got.genre_concentration == 0
    assert got.playlist_skip_rate == 0 and got.playlist_completion_tendency == 1
    assert (got.tier_encoded, got.age_group_encoded, got.country_frequency) == (0, 1, 0.1)
    assert got.high_energy_ratio == 0 and got.avg_energy_pref == 0
    other = of(fe.user_features(p, users, tracks(rows, ("t1", None, 0.9, 0.1))), "w")
    assert (other.tier_encoded, other.age_group_encoded, other.country_frequency) == (2, 4, 1.0)
    assert other.days_since_last_listen == 0 and other.high_energy_ratio == 1.0


def test_engagement_score(plays):
    got = of(fe.engagement(plays(("u", "2024-01-01 10:00"), ("u", "2024-01-02 09:00"), ("v", "2024-12-31 10:00"))))
    assert got.days_since_last_listen == 364 and got.avg_daily_sessions == 2.0
    import math
    assert got.engagement_score == pytest.approx(.3 * (1 - 364 / 365) + .4 * .2 + .3 * math.log1p(2) / 10)


def test_wide_frame(mart):
    engineer = FeatureEngineer()
    wide = engineer.create_all_features(mart.sessions, mart.users, mart.tracks)
    assert len(wide.columns) == 57 and engineer.feature_names == wide.columns
    listed = [n for names in engineer.get_feature_importance_groups().values() for n in names]
    assert len(listed) == 51 and set(listed) <= set(wide.columns)
    numeric = [c for c, t in wide.dtypes if t != "string"]
    nulls = wide.agg(*(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in numeric)).head()
    assert sum(nulls) == 0
    assert wide.count() == mart.sessions.select("user_id").distinct().count()


def test_wide_frame_has_no_python_and_no_global_sort(mart):
    plan = fe.user_features(mart.sessions, mart.users, mart.tracks)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_skip_features(mart):
    data, names, label = create_skip_prediction_features(mart.sessions, mart.tracks)
    assert len(names) == 25 and data.count() == mart.sessions.count()
    assert {r[0] for r in data.select(label).distinct().collect()} <= {0, 1}
    assert sum(data.agg(*(F.count_if(F.col(c).isNull()) for c in names)).head()) == 0


def test_skip_features_before_the_play(rows, plays):
    p = plays(("u", "2024-01-01 10:05", {"skipped": True}), ("u", "2024-01-01 10:20"), ("u", "2024-01-01 10:20"),
              ("u", "2024-01-02 08:00"))
    got = sk.skip_features(p, tracks(rows, ("t1", "pop", 0.5, 0.1)), point_in_time=True).orderBy("session_id").collect()
    assert [r.user_listen_count for r in got] == [0, 1, 1, 3]
    assert [r.user_historical_skip_rate for r in got] == pytest.approx([0, 1, 1, 1 / 3])


def test_forecast_features(mart):
    data, names, target = create_session_features(mart.sessions)
    assert target == "avg_duration" and len(names) == 7 and data.count() == 150


def test_sessionize_pause_at_the_limit(rows):
    stamps = ["10:00:00", "10:30:00", "11:00:01", "11:59:59"]
    df = rows([("u", f"2024-01-01 {t}") for t in stamps], "user_id string, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    got = sz.sessionize(df, "ts").orderBy("session_no").collect()
    assert [r.events for r in got] == [2, 1, 1]
    assert sz.label_sessions(df, "ts").count() == 4


def test_earlier_history_of_one_hot_hour(spark, rows):
    """All plays of one track in one hour, many at the same moment: exact, and no task holds them all."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    data = [(i, 7, rng.choice([rng.randrange(3_600_000), 1000 * rng.randrange(3600), 5_000]), rng.random() < 0.3 if i % 9 else None) for i in range(6000)]
    p = spark.createDataFrame(data, "session_id long, track_id long, ms long, skipped boolean").withColumn(
        "timestamp", F.timestamp_micros(F.lit(1_700_000_000_000_000 // 3_600_000_000 * 3_600_000_000) + F.col("ms") * 1000))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = sk.earlier_history(p, "track_id", "rate", "plays").withColumn("part", F.spark_partition_id())
        at = {r["_at"]: (r["rate"], r["plays"]) for r in found.collect()}
        sizes = [r["count"] for r in found.groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    base = 1_700_000_000_000_000 // 3_600_000_000 * 3_600_000_000
    for moment in rng.sample(sorted({d[2] for d in data}), 200):
        earlier = [d[3] for d in data if d[2] < moment]
        known = [s for s in earlier if s is not None]
        rate, plays = at[base + moment * 1000]
        assert plays == len(earlier)
        assert rate is None if not known else abs(rate - sum(known) / len(known)) < 1e-12
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line:  # windows hold totals only
            assert "_windowspecdefinition" in line or "sum(" in line
            assert "skipped#" not in line


def test_plays_without_time_or_key_have_no_history(spark, rows, plays):
    from pyspark.sql import functions as F

    p = plays(("u", "2024-01-01 10:00"), ("u", "2024-01-01 11:00"), (None, "2024-01-01 12:00"))
    p = p.unionByName(p.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp")).withColumn("session_id", F.lit("none")))
    got = {r.session_id: r.user_listen_count for r in sk.skip_features(p, tracks(rows, ("t1", "pop", 0.5, 0.1)), point_in_time=True).collect()}
    assert got == {"s0": 0, "s1": 1, "s2": 0, "none": 0}
