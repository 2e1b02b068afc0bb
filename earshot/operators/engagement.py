"""Activity, skip-rate and usage reports over plays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions.numbers import percent, ratio, round_half_up, skip_flag
from earshot.functions.times import (
    age_days, floor_days, hour_of, period_start, right_closed_bin, weekday_name,
)
from earshot.plans.calendar import days_of_users, month_openings
from earshot.operators.plays import (
    SKIP_TOTALS, mean_listen, merge_totals, play_totals, skip_percent, skip_share, totals_by_track,
)

# Least plays of each engagement segment.
SEGMENTS = {"Power User": 100, "Active": 30, "Casual": 10}


def engagement_segment(plays: Column, bounds: dict[str, int] = SEGMENTS) -> Column:
    chain = None
    for name, least in bounds.items():
        chain = F.when(plays >= least, name) if chain is None else chain.when(plays >= least, name)
    return chain.otherwise("Light")


# --- active users -----------------------------------------------------------

def dau_mau(sessions: DataFrame, ts: str = "timestamp", user: str = "user_id") -> DataFrame:
    """Daily and monthly active users with their ratio as a fraction.

    One scan and one shuffle of users with their dates give both: a day's users
    are the rows with that date, a month's users those whose first date of it this is.
    """
    days = (days_of_users(sessions, ts, user).select("user_id", F.inline(month_openings())).groupBy("date")
            .agg(F.count("user_id").alias("dau"), F.count(F.when(F.col("opens"), F.col("user_id"))).alias("newly_seen")))
    month = F.trunc("date", "month")
    mau = F.sum("newly_seen").over(Window.partitionBy(month))  # over one row per day
    return (days.select("date", "dau", F.date_format(month, "yyyy-MM").alias("month"), mau.alias("mau"))
            .withColumn("dau_mau_ratio", ratio("dau", "mau", None)))


def stickiness(sessions: DataFrame, ts: str = "timestamp", user: str = "user_id") -> DataFrame:
    """DAU over MAU in percent, two digits, by date."""
    return (dau_mau(sessions, ts, user)
            .select("date", "dau", "mau", percent("dau", "mau").alias("stickiness_ratio"))
            .orderBy("date"))


def stickiness_percent(sessions: DataFrame) -> DataFrame:
    """DAU over MAU in percent, unrounded, with the month label."""
    return dau_mau(sessions).select("date", "dau", "month", "mau",
                                    (F.col("dau_mau_ratio") * 100).alias("stickiness"))


def daily_active_users(sessions: DataFrame) -> DataFrame:
    """Per day: users, plays, mean listening time and skip rate."""
    per_user = play_totals(sessions, F.to_date("timestamp").alias("date"), "user_id")
    return (merge_totals(per_user, "date", extra=[F.count("user_id").alias("dau")])
            .select("date", "dau", F.col("plays").alias("total_sessions"),
                    mean_listen(1, None).alias("avg_listen_duration"),
                    ratio("skips", "plays", None).alias("skip_rate"))
            .orderBy("date"))


def monthly_active_users(sessions: DataFrame) -> DataFrame:
    per_user = (sessions.groupBy(period_start("timestamp").alias("month"), "user_id")
                .agg(F.count("*").alias("plays")))
    return (per_user.groupBy("month")
            .agg(F.count("user_id").alias("mau"), F.sum("plays").alias("total_sessions"))
            .orderBy("month"))


def user_cohort_summary(users: DataFrame, as_of) -> DataFrame:
    """Users and mean account age per signup month and tier, as of a given time."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return (users.groupBy(period_start("signup_date").alias("cohort_month"), "tier")
            .agg(F.count("*").alias("users"),
                 F.avg(age_days(as_of, "signup_date")).alias("avg_account_age_days"))
            .orderBy("cohort_month"))


# --- segments ---------------------------------------------------------------

def _per_user(sessions: DataFrame) -> DataFrame:
    return play_totals(sessions, "user_id").withColumn("listen_hours", F.col("listen_ms") / 3_600_000)


def engagement_segments(sessions: DataFrame, bounds: dict[str, int] = SEGMENTS) -> DataFrame:
    """Users, mean hours and mean of the users' skip rates per segment."""
    return (_per_user(sessions)
            .groupBy(engagement_segment(F.col("plays"), bounds).alias("user_segment"))
            .agg(F.count("*").alias("user_count"),
                 round_half_up(F.avg("listen_hours")).alias("avg_listen_hours"),
                 round_half_up(F.avg(ratio("skips", "plays", None)) * 100).alias("avg_skip_rate"))
            .orderBy(F.desc("user_count")))


def segment_summary(sessions: DataFrame, bounds: dict[str, int] = SEGMENTS) -> DataFrame:
    """Users, mean plays and mean hours per segment, unrounded."""
    return (_per_user(sessions)
            .groupBy(engagement_segment(F.col("plays"), bounds).alias("segment"))
            .agg(F.count("*").alias("users"), F.avg("plays").alias("avg_sessions"),
                 F.avg("listen_hours").alias("avg_hours")))


# --- skip rates: percent reports --------------------------------------------

def skip_report_by_genre(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    totals = merge_totals(totals_by_track(sessions, tracks, ["genre"]), "genre")
    return (totals.select("genre", F.col("plays").alias("total_plays"), "skips",
                          skip_percent().alias("skip_rate"),
                          mean_listen(1000).alias("avg_listen_seconds"))
            .orderBy(F.desc("skip_rate")))


def skip_report_by_hour(sessions: DataFrame) -> DataFrame:
    return (play_totals(sessions, hour_of("timestamp").alias("hour"))
            .select("hour", F.col("plays").alias("sessions"), skip_percent().alias("skip_rate"))
            .orderBy("hour"))


def skip_report_by_energy(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Below 0.3 low, below 0.7 medium, the rest - also unknown energy - high."""
    level = (F.when(F.col("energy") < 0.3, "Low Energy")
             .when(F.col("energy") < 0.7, "Medium Energy").otherwise("High Energy"))
    totals = merge_totals(totals_by_track(sessions, tracks, ["energy"]), level.alias("energy_level"))
    return (totals.select("energy_level", "plays", skip_percent().alias("skip_rate"))
            .orderBy("skip_rate"))


# --- skip rates: dashboard fractions and percent cuts -----------------------

def skip_rate_by(sessions: DataFrame, key: str, column: Column | None = None) -> DataFrame:
    """Share of skipped plays per non-null key."""
    key_column = F.col(key) if column is None else column
    return (play_totals(sessions, key_column.alias(key), names=SKIP_TOTALS).where(F.col(key).isNotNull())
            .select(key, skip_share().alias("skip_rate")))


def skip_rates(sessions: DataFrame, tracks: DataFrame) -> dict[str, DataFrame]:
    """Skip rate as a fraction by genre, hour and context."""
    by_genre = merge_totals(totals_by_track(sessions, tracks, ["genre"], how="left", names=SKIP_TOTALS)
                            .where(F.col("genre").isNotNull()), "genre")
    return {"by_genre": by_genre.select("genre", skip_share().alias("skip_rate")),
            "by_hour": skip_rate_by(sessions, "hour", hour_of("timestamp")),
            "by_context": skip_rate_by(sessions, "context")}


def skip_percent_by_genre(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Percent and plays per genre; unknown genre is a group of its own."""
    totals = merge_totals(totals_by_track(sessions, tracks, ["genre"], how="left"), "genre")
    return (totals.select("genre", (skip_share() * 100).alias("skip_rate"), "plays")
            .orderBy(F.desc("skip_rate")))


def skip_percent_by_hour(sessions: DataFrame) -> DataFrame:
    return skip_rate_by(sessions, "hour", hour_of("timestamp")).select(
        "hour", (F.col("skip_rate") * 100).alias("skip_rate"))


def skip_percent_by_energy(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Three bins closed on the right over (0, 1]; energy 0 or unknown is dropped."""
    level = right_closed_bin("energy", [0, 0.33, 0.66, 1], ["Low", "Medium", "High"])
    totals = (totals_by_track(sessions, tracks, ["energy"], how="left")
              .withColumn("energy_level", level).where(F.col("energy_level").isNotNull()))
    return merge_totals(totals, "energy_level").select(
        "energy_level", (skip_share() * 100).alias("skip_rate"))


# --- content ----------------------------------------------------------------

def top_tracks(sessions: DataFrame, tracks: DataFrame, least_plays: int = 10,
               limit: int = 100) -> DataFrame:
    """Tracks heard through most often; ties go to the smaller track id."""
    popular = play_totals(sessions, "track_id").where(F.col("plays") >= least_plays)
    heard = F.col("plays") - F.col("skips")
    share = mean_listen(1, None) / F.col("duration_ms") * 100
    return (popular.join(tracks.select("track_id", "genre", "duration_ms"), "track_id")
            .select("track_id", "genre", F.col("plays").alias("play_count"),
                    percent(heard, "plays").alias("listen_through_rate"),
                    round_half_up(share).alias("avg_completion_pct"))
            .orderBy(F.desc("listen_through_rate"), "track_id").limit(limit))


def genre_trends(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays per week and genre with the genre's share of the week in percent."""
    week = period_start("timestamp", "weekly").alias("week")
    weekly = merge_totals(totals_by_track(sessions, tracks, ["genre"], week), "week", "genre")
    return (weekly.withColumn("all_plays", F.sum("plays").over(Window.partitionBy("week")))
            .select("week", "genre", "plays", percent("plays", "all_plays").alias("genre_share"))
            .orderBy("week", F.desc("plays")))


def genre_distribution(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays per genre and percent of all; unknown genre is a group of its own."""
    totals = merge_totals(totals_by_track(sessions, tracks, ["genre"], how="left"), "genre")
    everything = F.sum("plays").over(Window.partitionBy())  # over one row per genre
    return (totals.select("genre", F.col("plays").alias("n"),
                          (ratio("plays", everything, None) * 100).alias("pct"))
            .orderBy(F.desc("n")))


# --- usage ------------------------------------------------------------------

def tier_patterns(users: DataFrame, sessions: DataFrame) -> DataFrame:
    joined = play_totals(sessions, "user_id").join(users.select("user_id", "tier"), "user_id")
    totals = merge_totals(joined, "tier", extra=[F.countDistinct("user_id").alias("users")])
    return (totals.select("tier", "users", F.col("plays").alias("total_sessions"),
                          round_half_up(ratio("plays", "users", None)).alias("sessions_per_user"),
                          mean_listen(60_000).alias("avg_listen_minutes"),
                          skip_percent().alias("skip_rate"))
            .orderBy(F.desc("sessions_per_user")))


def device_patterns(sessions: DataFrame) -> DataFrame:
    everything = F.sum("plays").over(Window.partitionBy())  # over one row per device
    return (play_totals(sessions, "device").withColumn("all_plays", everything)
            .select("device", F.col("plays").alias("sessions"),
                    percent("plays", "all_plays").alias("pct_sessions"),
                    mean_listen(60_000).alias("avg_listen_minutes"),
                    skip_percent().alias("skip_rate"))
            .orderBy(F.desc("sessions")))


def context_patterns(sessions: DataFrame) -> DataFrame:
    return (play_totals(sessions, "context")
            .select("context", F.col("plays").alias("sessions"), skip_percent().alias("skip_rate"),
                    mean_listen(60_000).alias("avg_duration_min"))
            .orderBy(F.desc("sessions")))


def listening_heatmap(sessions: DataFrame) -> DataFrame:
    """Plays per weekday name and hour; empty cells are absent."""
    return (sessions.groupBy(weekday_name("timestamp").alias("weekday"),
                             hour_of("timestamp").alias("hour"))
            .agg(F.count("*").alias("sessions")))


# --- daily retention --------------------------------------------------------

def retention_curve(users: DataFrame, sessions: DataFrame, days: int = 30) -> DataFrame:
    """Share of all users active exactly 0..``days`` days after signup."""
    # Dates meet their user as arrays that lie by user already; only the wanted ones become rows.
    ages = F.transform("days", lambda d: floor_days(d, F.col("signup_date")))
    since = (days_of_users(sessions).join(users.select("user_id", "signup_date"), "user_id")
             .select("user_id", F.explode(F.filter(ages, lambda age: age.between(0, days))).alias("day")))
    counts = since.groupBy("day").agg(F.countDistinct("user_id").alias("users"))
    everyone = users.agg(F.countDistinct("user_id")).scalar()
    calendar = users.sparkSession.range(days + 1).select(F.col("id").cast("int").alias("day"))
    return (calendar.join(counts, "day", "left")
            .select("day", F.coalesce("users", F.lit(0)).alias("users"))
            .withColumn("retention_rate", ratio("users", everyone, None))
            .orderBy("day"))


# --- per-user metrics table -------------------------------------------------

def metric_parts(sessions: DataFrame) -> DataFrame:
    """Sums per user and track that user metrics are made of; parts can be added up."""
    return (sessions.groupBy("user_id", "track_id")
            .agg(F.count("*").alias("plays"), F.sum(skip_flag()).alias("skips"),
                 F.sum("listen_duration_ms").alias("listen_ms"),
                 F.count("listen_duration_ms").alias("listens"),
                 F.max(F.to_date("timestamp")).alias("last_day")))


def merge_metric_parts(parts: DataFrame) -> DataFrame:
    return (parts.groupBy("user_id", "track_id")
            .agg(*(F.sum(c).alias(c) for c in ("plays", "skips", "listen_ms", "listens")),
                 F.max("last_day").alias("last_day")))


def metrics_of_parts(parts: DataFrame) -> DataFrame:
    """One metrics row per user, from one part per user and track."""
    return (parts.groupBy("user_id")
            .agg(F.sum("plays").alias("total_sessions"),
                 F.sum("listen_ms").alias("total_listen_time_ms"),
                 ratio(F.sum("skips"), F.sum("plays"), None).alias("skip_rate"),
                 ratio(F.sum("listen_ms"), F.sum("listens"), None).alias("avg_session_duration_ms"),
                 F.count("track_id").alias("unique_tracks_played"),
                 F.max("last_day").alias("last_active_date"))
            .select("user_id", "total_sessions", "total_listen_time_ms", "skip_rate",
                    "avg_session_duration_ms", "unique_tracks_played",
                    F.lit(None).cast("bigint").alias("unique_genres"), "last_active_date",
                    F.lit(None).cast("double").alias("engagement_score")))


def user_metrics(sessions: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """One metrics row per user. Genre and score columns are left unset.

    With ``updated_at``, the time of the run, rows carry it as the table's last column.
    """
    metrics = metrics_of_parts(metric_parts(sessions))
    return metrics if updated_at is None else metrics.withColumn("updated_at", updated_at.cast("timestamp"))


def upsert_user_metrics(current: DataFrame, sessions: DataFrame, changed: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """``current`` with the rows of ``changed`` users computed afresh.

    ``changed`` needs a ``user_id`` column. Untouched users are not recomputed, and keep the time of their last update;
    ``updated_at`` is by default the time of the run.
    """
    who = changed.select("user_id").distinct()
    stamp = None
    if "updated_at" in current.columns:
        stamp = F.current_timestamp() if updated_at is None else updated_at
    fresh = user_metrics(sessions.join(who, "user_id", "left_semi"), stamp)
    kept = current.join(sessions.select("user_id").join(who, "user_id", "left_semi").distinct(), "user_id", "left_anti")
    return kept.unionByName(fresh)
