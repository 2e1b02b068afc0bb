"""Additive play totals, the pre-aggregation most reports start from.

Totals are taken per key *before* a dimension is joined: a key that holds a
third of all plays becomes one row per map task instead of a hot join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions.numbers import percent, ratio, round_half_up, skip_flag

_TOTALS = {
    "plays": lambda: F.count("*"),
    "skips": lambda: F.sum(skip_flag()),
    "flagged": lambda: F.count("skipped"),
    "listens": lambda: F.count("listen_duration_ms"),
    "listen_ms": lambda: F.sum("listen_duration_ms"),
}


#: The totals behind :func:`skip_share`.
SKIP_TOTALS = ("skips", "flagged")


def play_totals(sessions: DataFrame, *keys: str | Column, names: tuple[str, ...] = tuple(_TOTALS)) -> DataFrame:
    """Per key those named of plays, skips, flagged (non-null flags), listens and listen_ms; by default all."""
    return sessions.groupBy(*keys).agg(*(_TOTALS[n]().alias(n) for n in names))


def merge_totals(totals: DataFrame, *keys: str | Column, extra: list[Column] = ()) -> DataFrame:
    """Roll those totals that are there up to coarser keys."""
    return totals.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in _TOTALS if n in totals.columns), *extra)


def totals_by_track(sessions: DataFrame, tracks: DataFrame, attributes: list[str],
                    *keys: Column, how: str = "inner", names: tuple[str, ...] = tuple(_TOTALS)) -> DataFrame:
    """Totals per (keys, track) with track attributes joined on."""
    return play_totals(sessions, *keys, "track_id", names=names).join(
        tracks.select("track_id", *attributes), "track_id", how)


# Finishing columns over totals.

def skip_percent() -> Column:
    """Skips per play in percent, two digits; an unset flag counts as no skip."""
    return percent("skips", "plays")


def skip_share() -> Column:
    """Skips per play with a known flag."""
    return ratio("skips", "flagged", None)


def mean_listen(unit_ms: float, digits: int | None = 2) -> Column:
    mean = ratio("listen_ms", "listens", None) / unit_ms
    return mean if digits is None else round_half_up(mean, digits)
