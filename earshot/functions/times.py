"""Column functions on dates and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000

#: Period name -> unit of ``trunc``.
PERIOD_UNITS = {"weekly": "week", "monthly": "month", "quarterly": "quarter"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _unit(period: str) -> str:
    try:
        return PERIOD_UNITS[period]
    except KeyError:
        raise ValueError(f"period must be one of {sorted(PERIOD_UNITS)}, not {period!r}") from None


def period_start(ts: Column | str, period: str = "monthly") -> Column:
    """First day of the week (Monday), month or quarter holding ``ts``."""
    return F.trunc(F.to_date(_col(ts)), _unit(period))


def periods_between(start: Column | str, end: Column | str, period: str = "monthly") -> Column:
    """Whole periods from ``start`` to ``end``, both first days of a period."""
    start, end = _col(start), _col(end)
    if _unit(period) == "week":
        return F.floor(F.datediff(end, start) / 7).cast("int")
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return (months if period == "monthly" else F.floor(months / 3)).cast("int")


def period_label(start: Column | str, period: str = "monthly") -> Column:
    """``2024-01``, ``2024Q1`` or ``2024-01-01/2024-01-07``."""
    start = _col(start)
    if _unit(period) == "month":
        return F.date_format(start, "yyyy-MM")
    if period == "quarterly":
        return F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string"))
    return F.concat(start.cast("string"), F.lit("/"), F.date_add(start, 6).cast("string"))


def floor_days(later: Column | str, earlier: Column | str) -> Column:
    """Days of 24 hours from ``earlier`` to ``later``, rounded down.

    Twelve hours backwards is -1 day; ``datediff`` would give 0.
    """
    gap = (F.unix_micros(_col(later).cast("timestamp"))
           - F.unix_micros(_col(earlier).cast("timestamp")))
    return ((gap - F.pmod(gap, F.lit(MICROS_PER_DAY))) / MICROS_PER_DAY).cast("int")


def age_days(as_of: Column, since: Column | str) -> Column:
    """Fractional days from ``since`` to ``as_of``."""
    gap = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(_col(since).cast("timestamp"))
    return gap / F.lit(float(MICROS_PER_DAY))


def hour_of(ts: Column | str) -> Column:
    return F.hour(_col(ts))


def is_weekend(ts: Column | str) -> Column:
    """Saturday or Sunday (``weekday`` counts from Monday = 0)."""
    return F.weekday(_col(ts)) >= 5


def weekday_name(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "EEEE")


# Parts of the day with the last hour of each, bins closed on the right.
DAY_PARTS = {"night": 6, "morning": 12, "afternoon": 18, "evening": 24}


def part_hours() -> dict[str, tuple[int, int]]:
    """First and last hour of each part of the day."""
    hours, first = {}, 0
    for name, last in DAY_PARTS.items():
        hours[name] = (first, min(last, 23))
        first = last + 1
    return hours


def right_closed_bin(value: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]``; null outside all bins."""
    value = _col(value)
    chain = F.when(value.isNull() | (value <= edges[0]), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        chain = chain.when(value <= edge, label)
    return chain
