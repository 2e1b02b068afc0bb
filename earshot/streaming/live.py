"""Live metrics on Structured Streaming.

Every function takes a streaming frame whose time column is a ``timestamp``
and returns a streaming frame; they work on batch frames alike. State is
bounded by the watermark: days, windows and sessions are closed and emitted
(append mode) once they lie behind it, and later events for them are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions.numbers import ratio
from earshot.operators.sketches import users_sketch


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions per user, closed ``gap`` after their last event."""
    return (events.withWatermark(ts, delay)
            .groupBy("user_id", F.session_window(ts, gap).alias("session"))
            .agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
                 F.count("*").alias("events"))
            .select("user_id", "session_start", "session_end", "events"))


def daily_active_users(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Exact daily active users: one state row per user and day, then a count per day."""
    per_user = (events.withWatermark(ts, delay)
                .groupBy(F.window(ts, "1 day"), "user_id").agg(F.count("*").alias("events")))
    return (per_user.groupBy(F.window(F.window_time("window"), "1 day").alias("day"))
            .agg(F.count("user_id").alias("dau"), F.sum("events").alias("events"))
            .select(F.to_date("day.start").alias("date"), "dau", "events"))


def approximate_daily_users(events: DataFrame, ts: str = "ts", delay: str = "1 hour",
                            error: float = 0.02) -> DataFrame:
    """Daily active users by sketch: constant state per day."""
    return (events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("day"))
            .agg(F.approx_count_distinct("user_id", error).alias("dau"))
            .select(F.to_date("day.start").alias("date"), "dau"))


def user_sketches(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One sketch of distinct users per closed day, to be stored: ``operators.sketches`` merges them to months and spans."""
    return (events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("day"))
            .agg(users_sketch().alias("sketch"), F.count("*").alias("events"))
            .select(F.to_date("day.start").alias("date"), "sketch", "events"))


def streaks(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Runs of consecutive active days per user, each emitted once it is over.

    A streak is a session of days: its state is one row that a further day extends and the watermark closes, when no event
    of the next day can come any more. The gap is a day and a bit, so neighbouring days join and a skipped day parts.
    """
    days = events.where(F.col("user_id").isNotNull()).withColumn("_day", F.date_trunc("day", F.col(ts))).withWatermark("_day", delay)
    return (days.groupBy("user_id", F.session_window("_day", "25 hours").alias("run"))
            .agg(F.min("_day").alias("first"), F.max("_day").alias("last"))
            .select("user_id", F.to_date("first").alias("first_day"), F.to_date("last").alias("last_day"),
                    (F.datediff("last", "first") + 1).alias("length")))


def rolling_rate(events: DataFrame, flag: Column, ts: str = "ts", length: str = "1 hour",
                 slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Share of events with ``flag`` in sliding windows, e.g. the skip rate of plays."""
    return (events.withWatermark(ts, delay).groupBy(F.window(ts, length, slide).alias("w"))
            .agg(F.count("*").alias("events"), F.count_if(flag).alias("hits"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events",
                    "hits", ratio("hits", "events", None).alias("rate")))


def experiment_moments(results: DataFrame, assignments: DataFrame, pivot: float = 0.0) -> DataFrame:
    """Count, mean above ``pivot`` and squared deviations from it (``m2``) per test, metric and arm.

    ``pivot`` is the mean that the plan expects. It is taken off before anything is summed, so sums stay as small as what the
    arms differ by, and squared deviations, unlike sums of squares, do not cancel where values lie close together.

    ``assignments`` is a table. A handful of state rows; use update or complete
    mode, and ``effects_from_moments`` on the outcome.
    """
    return _arm_values(results, assignments, pivot).groupBy("test_name", "metric_name", "variant").agg(*_moments(pivot))


def daily_moments(results: DataFrame, assignments: DataFrame, ts: str = "ts", pivot: float = 0.0,
                  delay: str = "1 hour") -> DataFrame:
    """The same per day, closed by the watermark: what ``sequential.looks`` needs."""
    timed = results.withWatermark(ts, delay)
    return (_arm_values(timed, assignments, pivot).groupBy(F.window(ts, "1 day").alias("_day"), "test_name", "metric_name", "variant")
            .agg(*_moments(pivot)).withColumn("day", F.to_date("_day.start")).drop("_day"))


def _arm_values(results: DataFrame, assignments: DataFrame, pivot: float) -> DataFrame:
    return (results.where(F.col("metric_value").isNotNull() & ~F.isnan(F.col("metric_value").cast("double")))
            .withColumn("_above", F.col("metric_value") - F.lit(float(pivot)))
            .join(assignments.select("user_id", "test_name", "variant"), ["user_id", "test_name"]))


def _moments(pivot: float) -> list[Column]:
    x = F.col("_above")
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
            F.first(F.lit(float(pivot))).alias("pivot")]
