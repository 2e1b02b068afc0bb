"""Signup cohorts: retention, engagement and churn.

The long form (one row per cohort and period) is canonical; matrix, statistics
and summary are small aggregations over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions.numbers import percent, ratio
from earshot.functions.times import floor_days, period_label, period_start, periods_between
from earshot.operators.plays import mean_listen, merge_totals, play_totals, skip_share


def assign_cohorts(users: DataFrame, period: str = "monthly") -> DataFrame:
    """Users with the first day of their signup period as ``cohort``."""
    return users.withColumn("cohort", period_start("signup_date", period))


def _cohort_of(users: DataFrame, period: str) -> DataFrame:
    return assign_cohorts(users, period).select("user_id", "cohort")


def cohort_sizes(users: DataFrame, period: str = "monthly") -> DataFrame:
    return (_cohort_of(users, period).groupBy("cohort")
            .agg(F.countDistinct("user_id").alias("cohort_size")))


def cohort_activity(users: DataFrame, sessions: DataFrame, period: str = "monthly",
                    periods: int | None = None) -> DataFrame:
    """Active users per cohort and period since signup.

    Plays shrink to distinct (user, period) before they meet the users.
    Activity before the signup period is left out.
    """
    active = (sessions.select("user_id", period_start("timestamp", period).alias("activity_period"))
              .distinct())
    joined = (active.join(_cohort_of(users, period), "user_id")
              .where(F.col("activity_period") >= F.col("cohort"))
              .withColumn("period_number", periods_between("cohort", "activity_period", period)))
    if periods is not None:
        joined = joined.where(F.col("period_number") < periods)
    return (joined.groupBy("cohort", "activity_period", "period_number")
            .agg(F.countDistinct("user_id").alias("active_users")))


def retention(users: DataFrame, sessions: DataFrame, period: str = "monthly",
              periods: int | None = 12) -> DataFrame:
    """cohort, period_number, active_users, cohort_size and retention_rate in percent."""
    return (cohort_activity(users, sessions, period, periods)
            .join(cohort_sizes(users, period), "cohort")
            .select("cohort", "activity_period", "period_number", "active_users", "cohort_size",
                    (ratio("active_users", "cohort_size", None) * 100).alias("retention_rate")))


def monthly_retention_report(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """All months since signup, the rate rounded to two digits."""
    return (cohort_activity(users, sessions).join(cohort_sizes(users), "cohort")
            .select(F.col("cohort").alias("cohort_month"), "cohort_size",
                    F.col("activity_period").alias("activity_month"),
                    F.col("period_number").alias("months_since_signup"),
                    F.col("active_users").alias("users"),
                    percent("active_users", "cohort_size").alias("retention_rate"))
            .orderBy("cohort_month", "activity_month"))


def _rate_at(number: int) -> Column:
    return F.max(F.when(F.col("period_number") == number, F.col("retention_rate")))


def retention_matrix(long_form: DataFrame, periods: int = 12) -> DataFrame:
    """One row per cohort, one ``period_<n>`` column per period; no activity is null."""
    return long_form.groupBy("cohort").agg(
        *(_rate_at(n).alias(f"period_{n}") for n in range(periods)))


def cohort_stats(users: DataFrame, long_form: DataFrame, period: str = "monthly") -> DataFrame:
    """Size and retention at periods 0, 1 and 3 of every cohort, also inactive ones."""
    rates = long_form.groupBy("cohort").agg(_rate_at(0).alias("initial_retention"),
                                            _rate_at(1).alias("period_1_retention"),
                                            _rate_at(3).alias("period_3_retention"))
    return cohort_sizes(users, period).join(rates, "cohort", "left")


def retention_summary(long_form: DataFrame, period: str = "monthly") -> DataFrame:
    """One row: mean retention at 0, 1, 3, 6 and the best and worst cohort at 1.

    Ties go to the earlier cohort; a period no cohort reaches has mean 0.
    """
    wide = long_form.groupBy("cohort").agg(*(_rate_at(n).alias(f"p{n}") for n in (0, 1, 3, 6)))
    day = F.unix_date("cohort")
    known = F.col("p1").isNotNull()
    best = F.max_by("cohort", F.when(known, F.struct(F.col("p1"), -day)))
    worst = F.min_by("cohort", F.when(known, F.struct(F.col("p1"), day)))
    means = [F.coalesce(F.avg(f"p{n}"), F.lit(0.0)).alias(name) for n, name in
             ((0, "avg_initial_retention"), (1, "avg_period_1_retention"),
              (3, "avg_period_3_retention"), (6, "avg_period_6_retention"))]
    return wide.agg(*means, period_label(best, period).alias("best_cohort"),
                    period_label(worst, period).alias("worst_cohort"),
                    F.count("*").alias("num_cohorts"))


def average_retention(long_form: DataFrame) -> DataFrame:
    """Mean over cohorts per period with a 95 % interval (normal, null for one cohort)."""
    half = F.lit(1.96) * F.col("se")
    return (long_form.groupBy("period_number")
            .agg(F.avg("retention_rate").alias("avg_retention"),
                 (F.stddev_samp("retention_rate") / F.sqrt(F.count("*"))).alias("se"))
            .select("period_number", "avg_retention", "se",
                    (F.col("avg_retention") - half).alias("ci_lower"),
                    (F.col("avg_retention") + half).alias("ci_upper")))


# --- engagement -------------------------------------------------------------

def _cohort_totals(users: DataFrame, sessions: DataFrame, period: str) -> DataFrame:
    joined = play_totals(sessions, "user_id").join(_cohort_of(users, period), "user_id")
    return merge_totals(joined, "cohort", extra=[F.countDistinct("user_id").alias("unique_users")])


def cohort_engagement(users: DataFrame, sessions: DataFrame, period: str = "monthly") -> DataFrame:
    """Users, plays, listening time and skip rate per cohort."""
    hours = F.col("listen_ms") / F.col("unique_users") / 3_600_000
    return _cohort_totals(users, sessions, period).select(
        period_label("cohort", period).alias("cohort"), "unique_users",
        F.col("plays").alias("total_sessions"), F.col("listen_ms").alias("total_listen_time_ms"),
        mean_listen(1, None).alias("avg_listen_duration_ms"), skip_share().alias("skip_rate"),
        ratio("plays", "unique_users", None).alias("sessions_per_user"),
        hours.alias("listen_hours_per_user"))


def cohort_engagement_hours(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """The same per month in hours, minutes and percent."""
    return _cohort_totals(users, sessions, "monthly").select(
        "cohort", "unique_users", F.col("plays").alias("total_sessions"),
        (F.col("listen_ms") / 3_600_000).alias("total_listen_time_hrs"),
        mean_listen(60_000, None).alias("avg_listen_duration_min"),
        (skip_share() * 100).alias("skip_rate"),
        ratio("plays", "unique_users", None).alias("sessions_per_user"))


# --- churn ------------------------------------------------------------------

def churn_risk(users: DataFrame, sessions: DataFrame, days_inactive: int = 30,
               as_of: Column | None = None) -> DataFrame:
    """Users with last activity, full days since then, and a risk flag.

    "Now" is the last play of the data unless given. Users who never played
    are at risk, with 999 days.
    """
    now = sessions.agg(F.max("timestamp")).scalar() if as_of is None else as_of
    last = sessions.groupBy("user_id").agg(F.max("timestamp").alias("last_activity"))
    gone = F.coalesce(floor_days("now", "last_activity"), F.lit(999))
    return (users.join(last.withColumn("now", now), "user_id", "left")
            .withColumn("days_inactive", gone).drop("now")
            .withColumn("churn_risk", F.col("last_activity").isNull()
                        | (F.col("days_inactive") >= days_inactive)))


def churned_users(users: DataFrame, sessions: DataFrame, inactive_days: int = 30,
                  as_of: Column | None = None) -> DataFrame:
    """The same by calendar days; users who never played are churned, days unknown."""
    today = F.to_date(sessions.agg(F.max("timestamp")).scalar() if as_of is None else as_of)
    last = sessions.groupBy("user_id").agg(F.to_date(F.max("timestamp")).alias("last_active"))
    return (users.join(last.withColumn("today", today), "user_id", "left")
            .withColumn("days_inactive", F.datediff("today", "last_active")).drop("today")
            .withColumn("is_churned", F.col("days_inactive").isNull()
                        | (F.col("days_inactive") >= inactive_days)))


def churn_rate(churn: DataFrame) -> DataFrame:
    """Percent of users churned."""
    return churn.agg((F.avg(F.col("is_churned").cast("double")) * 100).alias("churn_rate"))


def cohort_overview(users: DataFrame, sessions: DataFrame, periods: int = 12) -> DataFrame:
    """One row: users, plays, active cohorts, mean retention at period 1, churn rate."""
    by_cohort = retention(users, sessions, "monthly", periods).groupBy("cohort").agg(
        _rate_at(1).alias("p1"))
    facts = by_cohort.agg(F.count("*").alias("num_cohorts"), F.avg("p1").alias("avg_period_1_retention"))
    churn = churned_users(users, sessions)
    return facts.select(
        users.agg(F.count("*")).scalar().alias("total_users"),
        sessions.agg(F.count("*")).scalar().alias("total_sessions"),
        "num_cohorts", "avg_period_1_retention",
        churn_rate(churn).scalar().alias("churn_rate"))
