"""Stored sketches, streaks from a stream, and plays stored by user."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from earshot.operators import engagement as eng, features as fe, sketches as sk
from earshot.sources import layout
from earshot.streaming import live


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def events_of(spark, data):
    """(user, day number) pairs as events at noon."""
    return spark.createDataFrame([(u, n) for u, n in data], "user_id long, n int").select(
        "user_id", (F.lit("2024-01-01 12:00:00").cast("timestamp") + F.expr("make_interval(0, 0, 0, n)")).alias("ts"))


def test_sketches_merge_to_any_span(spark):
    data = [(u, n) for n in (0, 1, 2, 30, 31, 60) for u in range(n, n + 200)] + [(None, 0), (None, 90)]
    daily = sk.daily_sketches(events_of(spark, data))
    got = {r.date: r.users for r in sk.days(daily).collect()}
    exact = {n: len({u for u, m in data if m == n and u is not None}) for n in (0, 1, 2, 30, 31, 60, 90)}
    assert set(got) == {day(n) for n in exact}
    for n, users in exact.items():
        assert got[day(n)] == pytest.approx(users, rel=0.05)
    rolling = {r.date: r.users for r in sk.rolling(daily).collect()}
    for n in exact:
        want = len({u for u, m in data if n - 28 < m <= n and u is not None})
        assert rolling[day(n)] == pytest.approx(want, rel=0.05)
    months = {r.month: r.users for r in sk.months(daily).collect()}
    for month in {day(n).replace(day=1) for n in exact}:
        assert months[month] == pytest.approx(len({u for u, m in data if day(m).replace(day=1) == month and u is not None}), rel=0.05)


def test_parts_of_a_day_are_merged(spark):
    parts = [sk.daily_sketches(events_of(spark, [(u, 0) for u in range(a, a + 300)])) for a in (0, 200)]
    both = parts[0].unionByName(parts[1])
    assert sk.days(both).count() == 1 and sk.days(both).head().users == pytest.approx(500, rel=0.05)
    assert sk.days(parts[0].limit(0)).count() == 0


def closed_streaks(spark, folder, feeds):
    for data in feeds:
        events_of(spark, data).coalesce(1).write.mode("append").parquet(f"{folder}/inbox")
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{folder}/inbox")
        query = (live.streaks(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
                 .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    return sorted((r.user_id, r.first_day, r.last_day, r.length) for r in spark.read.parquet(f"{folder}/out").collect())


def test_streaks_are_closed_after_the_gap(spark, tmp_path):
    feeds = [[(1, 0), (1, 1), (2, 0)], [(1, 2), (2, 2), (None, 2)], [(2, 3), (2, 3)], [(1, 9)], [(1, 30)]]
    got = closed_streaks(spark, str(tmp_path), feeds)
    assert got == [(1, day(0), day(2), 3), (1, day(9), day(9), 1), (2, day(0), day(0), 1), (2, day(2), day(3), 2)]


def test_closed_streaks_are_those_of_the_features(spark, tmp_path):
    import random

    rng = random.Random(1)
    data = [(u, n) for u in range(20) for n in range(40) if rng.random() < 0.5]
    got = closed_streaks(spark, str(tmp_path), [[d for d in data if d[1] // 10 == k] for k in range(4)] + [[(99, 100)], [(99, 101)]])
    features = {r.user_id: r for r in fe.streaks(events_of(spark, data), "ts").collect()}
    for u in range(20):
        lengths = [n for user, _, _, n in got if user == u]
        f = features[u]
        assert (max(lengths), len(lengths), sum(lengths), lengths[-1]) == (f.max_streak, f.streak_count, f.active_days, f.current_streak)


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_per_user_work_shuffles_nothing(spark, mart, tmp_path):
    plays = layout.save_bucketed(mart.sessions, "layout_plays", str(tmp_path / "plays"), buckets=4)
    totals = plays.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks"))
    assert "Exchange hashpartitioning" not in plan(totals)
    assert "Exchange hashpartitioning" not in plan(eng.user_metrics(plays))
    users = layout.save_bucketed(mart.users, "layout_users", str(tmp_path / "users"), order=(), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = plays.join(users.select("user_id", "tier"), "user_id")
        assert "Exchange hashpartitioning" not in plan(joined)
        assert joined.count() == mart.sessions.join(mart.users, "user_id").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 << 20)
        spark.sql("drop table layout_plays")
        spark.sql("drop table layout_users")


def test_bucketed_rows_are_all_rows(spark, plays, tmp_path):
    p = plays(("a", "2024-01-01 10:00"), (None, "2024-01-01 11:00"), ("a", "2024-01-01 09:00"))
    stored = layout.save_bucketed(p, "layout_odd", str(tmp_path / "odd"), buckets=2)
    assert sorted(map(str, stored.collect())) == sorted(map(str, p.collect()))
    spark.sql("drop table layout_odd")
