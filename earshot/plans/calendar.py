"""Active days without a row per day: one bit each by user and month, or one array by user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def active_days(events: DataFrame, ts: str = "timestamp", user: str = "user_id") -> DataFrame:
    """user_id, month (its first day) and days: bit d set if active on day d of the month.

    Bits are combined inside each map task, so what is shuffled does not grow
    with the number of events, only with users and months.
    """
    days = (events.select(F.col(user).alias("user_id"), F.to_date(ts).alias("_day"))
            .where(F.col("_day").isNotNull())
            .select("user_id", F.trunc("_day", "month").alias("month"),
                    F.expr("shiftleft(1L, dayofmonth(_day))").alias("_bit")))
    return days.groupBy("user_id", "month").agg(F.bit_or("_bit").alias("days"))


def days_of_users(events: DataFrame, ts: str = "timestamp", user: str = "user_id") -> DataFrame:
    """user_id and days: an array of the dates on which the user is active, in order.

    Dates are gathered inside each map task and shuffled as one row per user and task, by the
    user alone: what follows by user, a join too, shuffles them no more.
    """
    days = (events.select(F.col(user).alias("user_id"), F.to_date(ts).alias("_day"))
            .where(F.col("_day").isNotNull()))
    return days.groupBy("user_id").agg(F.sort_array(F.collect_set("_day")).alias("days"))


def month_openings() -> Column:
    """Array of (date, opens) behind ``days``; ``opens`` marks a user's first date in a month."""
    return F.expr("transform(days, (d, i) -> named_struct('date', d, 'opens', "
                  "coalesce(trunc(d, 'month') > trunc(get(days, i - 1), 'month'), true)))")


def dates_of(months: str) -> Column:
    """The dates behind an array of (month, days), months in order."""
    return F.expr(f"flatten(transform({months}, m -> transform(filter(sequence(1, 31), d -> (shiftright(m.days, d) & 1L) = 1L), "
                  "d -> date_add(m.month, d - 1))))")
