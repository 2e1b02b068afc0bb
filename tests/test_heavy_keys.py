"""Plays are shuffled once by key; keys that hold a share of all plays take another way to the same rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from earshot.operators import features as fe, skip_features as sk
from earshot.plans import heavy


@pytest.fixture
def no_broadcasts(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def shuffled_by(df) -> list[str]:
    """First column of each hash shuffle of the plan."""
    return re.findall(r"Exchange hashpartitioning\((\w+?)#", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def odd_plays(spark):
    """One user and one track of many plays, many plays at one moment, keys, times and flags that are missing."""
    rng = random.Random(4)

    def one(i):
        user, track = rng.choice(["u", "u", "v", "w", f"x{rng.randrange(30)}", None]), rng.choice(["t", "t", f"s{rng.randrange(30)}", None])
        return (f"p{i}" if i % 17 else None, user, track, None if i % 13 == 0 else rng.choice([rng.randrange(90), 7]), rng.choice([True, False, None]),
                rng.choice(["playlist", "album", "other", None]), rng.choice(["mobile", "watch", None]))
    df = spark.createDataFrame([one(i) for i in range(700)], "session_id string, user_id string, track_id string, s long, skipped boolean, context string, device string")
    return df.withColumn("timestamp", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("s") * 1_000_000)).drop("s").persist()


@pytest.fixture(scope="module")
def odd_tracks(spark):
    """A track that comes twice, and one that no play has."""
    data = [(t, *(float(i + j) for j in range(len(sk.AUDIO)))) for i, t in enumerate(["t", "t", "s1", "none", None])]
    return spark.createDataFrame(data, "track_id string, " + ", ".join(f"{a} double" for a in sk.AUDIO))


def test_skip_features_shuffle_plays_once_by_key(no_broadcasts, odd_plays, odd_tracks):
    assert sorted(shuffled_by(sk.skip_features(odd_plays, odd_tracks, point_in_time=True))) == ["track_id", "track_id", "user_id"]  # plays and tracks, plays


@pytest.mark.parametrize("least", [10**6, 20])
def test_history_of_light_and_heavy_keys(monkeypatch, odd_plays, odd_tracks, least):
    monkeypatch.setattr(heavy, "_LEAST", least)
    assert bool(heavy.key_sizes(odd_plays, "user_id").heavy) == (least == 20)
    plays = odd_plays.collect()
    copies = {t: max(1, sum(r.track_id == t for r in odd_tracks.collect())) for t in {p.track_id for p in plays} - {None}}
    expected = []
    for p in plays:
        def earlier(name):
            if p[name] is None or p.timestamp is None:
                return []
            return [q for q in plays if q[name] == p[name] and q.timestamp is not None and q.timestamp < p.timestamp]

        def rate(rows):
            known = [q.skipped for q in rows if q.skipped is not None]
            return sum(known) / len(known) if known else 0.0
        mine, same = earlier("user_id"), earlier("track_id")
        row = (p.session_id, p.user_id, p.track_id, rate(mine), float(sum(q.session_id is not None for q in mine)), rate(same),
               float(p.context == "playlist"), float(p.context == "album"), float(p.device == "mobile"), p.skipped)
        expected += [row] * copies.get(p.track_id, 1)
    found = sk.skip_features(odd_plays, odd_tracks, point_in_time=True).select(
        "session_id", "user_id", "track_id", "user_historical_skip_rate", "user_listen_count", "track_skip_rate",
        "context_playlist", "context_album", "device_mobile", F.col("skipped").cast("boolean"))
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, expected))


@pytest.fixture(scope="module")
def star(spark, odd_plays):
    """The odd plays with lengths, users of whom one comes twice and one is missing, tracks with and without a genre."""
    plays = odd_plays.withColumns({"listen_duration_ms": F.pmod(F.xxhash64("session_id", "timestamp"), F.lit(1000)),
                                   "track_duration_ms": F.when(F.col("skipped"), 1000).otherwise(2000).cast("bigint")})
    users = spark.createDataFrame([("u", "free", "DE", None), ("u", "premium", "DE", "18-24"), ("v", "odd", None, "55+"), ("x1", "family", "US", "25-34")],
                                  "user_id string, tier string, country string, age_group string")
    tracks = spark.createDataFrame([(t, g, *(float(i + j) / 40 for j in range(5))) for i, (t, g) in enumerate([("t", "pop"), ("s1", "rock"), ("s2", None), *((f"s{k}", f"g{k % 7}") for k in range(3, 30))])],
                                   "track_id string, genre string, " + ", ".join(f"{a} double" for a in fe.PREFERENCE_AUDIO))
    return plays, users, tracks


def test_user_features_shuffle_plays_by_user_alone(spark, no_broadcasts, star):
    """No rows that aggregate next to nothing, of which there are several a play, are dealt by user and grain."""
    plan = fe.user_features(*star)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(user_id#\w+, grain#", plan)
    dealt = re.findall(r"Exchange hashpartitioning\(user_id#[^,]*, \d+\), REPARTITION_BY_COL", plan)
    assert len(dealt) == 2  # narrow plays, for plain aggregates and for grains


def test_user_features_of_light_and_heavy_users(monkeypatch, star):
    def found():
        return {(r.user_id, r.tier): r.asDict() for r in fe.user_features(*star).collect()}
    expected = found()
    assert len(expected) == star[0].select("user_id").where("user_id is not null").distinct().count() + 1  # u comes twice
    monkeypatch.setattr(heavy, "_LEAST", 20)
    assert len(heavy.key_sizes(star[0].where("user_id is not null"), "user_id").heavy) == 3
    mixed = found()
    assert mixed.keys() == expected.keys()
    for key, row in expected.items():
        assert {n: v for n, v in mixed[key].items() if isinstance(v, float)} == pytest.approx({n: v for n, v in row.items() if isinstance(v, float)}), key
        assert {n: v for n, v in mixed[key].items() if not isinstance(v, float)} == {n: v for n, v in row.items() if not isinstance(v, float)}, key


def test_key_sizes_are_exact(spark, monkeypatch):
    df = spark.range(1000).select(F.when(F.col("id") < 300, 7).when(F.col("id") < 500, F.lit(None)).otherwise(F.col("id")).cast("bigint").alias("k"))
    assert heavy.key_sizes(df, "k") == heavy.KeySizes(1000)
    monkeypatch.setattr(heavy, "_LEAST", 200)
    assert heavy.key_sizes(df, "k").heavy == (7,)  # null has 200 rows, not more
    monkeypatch.setattr(heavy, "_LEAST", 199)
    sizes = heavy.key_sizes(df, "k")
    assert set(sizes.heavy) == {7, None} and df.where(sizes.is_heavy("k")).count() == 500 and df.where(~sizes.is_heavy("k")).count() == 500


def test_many_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(heavy, "_TASK_ROWS", 100)
    assert heavy.dealt(spark.range(1000), "id", 1000).rdd.getNumPartitions() == 10
