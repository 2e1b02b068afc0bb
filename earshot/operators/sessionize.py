"""Sessions out of raw events: runs of a user's events without a long pause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _bins(events: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Events aggregated to bins as wide as the allowed pause.

    Two events of one bin are always closer than the pause, so a bin belongs
    to one session as a whole: plain aggregation does most of the work, and a
    user has at most one row per bin, however many events.
    """
    width = minutes * 60_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return (events.where(F.col("user_id").isNotNull() & F.col(ts).isNotNull())
            .groupBy("user_id", ((micros - F.pmod(micros, F.lit(width))) / width).cast("bigint").alias("bin"))
            .agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("events")))


def _numbered_bins(events: DataFrame, ts: str, minutes: int) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("bin")
    pause = (F.unix_micros(F.col("first").cast("timestamp"))
             - F.unix_micros(F.lag("last").over(order).cast("timestamp")))
    starts = F.when(pause <= minutes * 60_000_000, 0).otherwise(1)
    return (_bins(events, ts, minutes).withColumn("starts", starts)
            .withColumn("session_no", F.sum("starts").over(order)))


def sessionize(events: DataFrame, ts: str = "timestamp", minutes: int = 30) -> DataFrame:
    """user_id, session_no (from 1 per user), session_start, session_end, events.

    A pause of more than ``minutes`` starts a new session.
    """
    return (_numbered_bins(events, ts, minutes).groupBy("user_id", "session_no")
            .agg(F.min("first").alias("session_start"), F.max("last").alias("session_end"),
                 F.sum("events").alias("events")))


def label_sessions(events: DataFrame, ts: str = "timestamp", minutes: int = 30) -> DataFrame:
    """All events with the ``session_no`` they belong to; null for events without a user or a time."""
    width = minutes * 60_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    bins = _numbered_bins(events, ts, minutes).select("user_id", "bin", "session_no")
    return (events.withColumn("bin", ((micros - F.pmod(micros, F.lit(width))) / width).cast("bigint"))
            .join(bins, ["user_id", "bin"], "left").drop("bin"))
