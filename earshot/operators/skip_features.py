"""One feature row per play for the skip model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions.times import hour_of, is_weekend
from earshot.plans.heavy import dealt, key_sizes
from earshot.schemas import AUDIO, DOMAINS

CONTEXTS = DOMAINS["sessions"]["context"]
DEVICES = DOMAINS["sessions"]["device"]

SKIP_FEATURES = (AUDIO + ["hour", "is_weekend", "is_morning", "is_evening",
                          "user_historical_skip_rate", "user_listen_count", "track_skip_rate"]
                 + [f"context_{c}" for c in CONTEXTS] + [f"device_{d}" for d in DEVICES])

#: Columns of the plays that skip features are made of.
PLAY_COLUMNS = ("session_id", "user_id", "track_id", "timestamp", "skipped", "context", "device")


def _flag() -> Column:
    return F.col("skipped").cast("double")


def _history(sessions: DataFrame, key: str, rate: str, count: str) -> DataFrame:
    return sessions.groupBy(key).agg(F.avg(_flag()).alias(rate), F.count("session_id").alias(count))


#: Microseconds of a slot: a key has at most ten million moments in a slot, and three million slots a year.
_SLOT = 10_000_000
_SUMS = ("skips", "flags", "plays")


def earlier_history(sessions: DataFrame, key: str, rate: str, count: str) -> DataFrame:
    """Rate and count over the plays of ``key`` strictly before each moment at which it has plays: key, _at, rate, count.

    Prefix sums over a radix of time. Plays become totals per moment, and these totals per slot of ten seconds. What lies
    before a moment is the earlier slots and the earlier moments of its slot; both are windows over totals whose number the
    clock bounds. No window holds plays, so a key with a third of all plays in one hour, or in one moment, is no harder than
    any other.
    """
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    moments = (sessions.where(F.col(key).isNotNull() & F.col("timestamp").isNotNull()).groupBy(key, at.alias("_at"))
               .agg(F.sum(_flag()).alias("skips"), F.count("skipped").alias("flags"), F.count("session_id").alias("plays"))
               .withColumn("_slot", F.floor(F.col("_at") / _SLOT)))

    def before(totals, level, *parts):
        """What earlier rows of the same part of the radix add up to, as ``<name>_<level>``."""
        earlier = Window.partitionBy(key, *parts).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumns({f"{n}{level}": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in _SUMS}).drop(*_SUMS)

    slots = before(moments.groupBy(key, "_slot").agg(*(F.sum(n).alias(n) for n in _SUMS)), "_slot")
    placed = before(moments, "_at", "_slot").join(slots, [key, "_slot"])
    so_far = {n: F.col(f"{n}_slot") + F.col(f"{n}_at") for n in _SUMS}
    return placed.select(key, "_at", F.try_divide(so_far["skips"], so_far["flags"]).alias(rate), so_far["plays"].alias(count))


def _with_earlier_history(plays: DataFrame, sessions: DataFrame, key: str, rate: str, count: str,
                          attributes: DataFrame | None = None) -> DataFrame:
    """``plays`` with rate and count over the earlier plays of their key in ``sessions``, whose rows they are, and attributes of the key.

    A play without a time or key has no earlier ones. Plays are shuffled once, by key: their history is a window over the key's
    plays, and the attributes are joined where the plays lie. Plays of heavy keys, which would be more than a task should
    hold, meet the totals of :func:`earlier_history` instead.
    """
    sizes = key_sizes(sessions, key)
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))

    def attributed(placed):
        return placed.drop("_at") if attributes is None else placed.drop("_at").join(attributes, key, "left")

    earlier = Window.partitionBy(key).orderBy(F.col("_at").asc_nulls_last()).rangeBetween(Window.unboundedPreceding, -1)
    known = F.col(key).isNotNull() & F.col("_at").isNotNull()
    light = plays.where(~sizes.is_heavy(key)) if sizes.heavy else plays
    found = attributed(dealt(light, key, sizes.rows).withColumn("_at", at).withColumns({
        rate: F.when(known, F.try_divide(F.sum(_flag()).over(earlier), F.count("skipped").over(earlier))),
        count: F.when(known, F.count("session_id").over(earlier)).otherwise(F.lit(0))}))
    if not sizes.heavy:
        return found
    history = earlier_history(sessions.where(sizes.is_heavy(key)), key, rate, count)
    heavy = plays.where(sizes.is_heavy(key)).withColumn("_at", at).join(history, [key, "_at"], "left")
    return found.unionByName(attributed(heavy.withColumn(count, F.coalesce(F.col(count), F.lit(0)))))


def _marks() -> dict[str, Column]:
    """Condition behind each one-hot column."""
    return {**{f"context_{c}": F.col("context") == c for c in CONTEXTS}, **{f"device_{d}": F.col("device") == d for d in DEVICES}}


def skip_features(sessions: DataFrame, tracks: DataFrame, point_in_time: bool = False) -> DataFrame:
    """Audio, time, history and one-hot columns with the label ``skipped``.

    History covers all plays of the user and track, the current one included,
    as the established features do; ``point_in_time`` restricts it to earlier
    plays. Statistics are grouped per key and joined back: on a hot key the
    join can be split, a window could not. ``point_in_time`` reads the plays
    to tell heavy keys from others, so they should be stored.
    """
    hour = hour_of("timestamp")
    marks = _marks()
    if point_in_time:
        # One number instead of two texts goes through the shuffles.
        bits = {name: 1 << i for i, name in enumerate(marks)}
        marked = sum((F.when(mark, bits[name]).otherwise(0) for name, mark in marks.items()), F.lit(0))
        joined = sessions.select("session_id", "user_id", "track_id", "timestamp", "skipped", marked.alias("_marks"))
        joined = _with_earlier_history(joined, sessions, "user_id", "user_historical_skip_rate", "user_listen_count")
        joined = _with_earlier_history(joined, sessions, "track_id", "track_skip_rate", "track_count", tracks.select("track_id", *AUDIO))
        marks = {name: F.col("_marks").bitwiseAND(bit) != 0 for name, bit in bits.items()}
    else:
        by_track = _history(sessions, "track_id", "track_skip_rate", "track_count")
        track_side = by_track.join(tracks.select("track_id", *AUDIO), "track_id", "left")
        by_user = _history(sessions, "user_id", "user_historical_skip_rate", "user_listen_count")
        joined = sessions.join(track_side, "track_id", "left").join(by_user, "user_id", "left")
    columns = {
        **{name: F.col(name) for name in AUDIO}, "hour": hour,
        "is_weekend": is_weekend("timestamp").cast("int"),
        "is_morning": ((hour >= 6) & (hour < 12)).cast("int"),
        "is_evening": ((hour >= 18) & (hour < 24)).cast("int"),
        "user_historical_skip_rate": F.col("user_historical_skip_rate"),
        "user_listen_count": F.col("user_listen_count"), "track_skip_rate": F.col("track_skip_rate"),
        **{name: F.when(mark, 1).otherwise(0) for name, mark in marks.items()},
    }
    return joined.select(
        "session_id", "user_id", "track_id",
        *(F.coalesce(columns[n].cast("double"), F.lit(0.0)).alias(n) for n in SKIP_FEATURES),
        F.col("skipped").cast("int").alias("skipped"))
