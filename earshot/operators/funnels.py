"""Funnels: staged counts, conversion, drop-off, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions.numbers import clip, ratio, skip_flag
from earshot.functions.times import floor_days, period_start

# Stage names and their thresholds.
COMPLETION_STAGES = {
    "started": None,
    "track_1_complete": ("tracks_completed", 1),
    "track_3_complete": ("tracks_completed", 3),
    "track_5_complete": ("tracks_completed", 5),
    "50_percent_complete": ("completion_ratio", 0.5),
    "75_percent_complete": ("completion_ratio", 0.75),
    "100_percent_complete": ("completion_ratio", 1.0),
}
ACTIVATION_STAGES = ["signed_up", "first_session", "activated_day_1", "active_week_1",
                     "retained_week_2", "weekly_active"]

# Advice texts and the drop-offs that call for them.
STAGE_ADVICE = "High drop-off (%.1f%%) at '%s'. Consider optimizing this stage."
TRACK_ADVICE = ("Significant drop-off (%.1f%%) between tracks 3-5. "
                "Consider improving track recommendations or playlist ordering.")
HEALTHY_ADVICE = "Funnel performance looks healthy. Continue monitoring."
STAGE_LIMIT, TRACK_LIMIT = 0.20, 0.15


# --- generic stage tables ---------------------------------------------------

def _drop(before: Column | str, users: Column | str) -> Column:
    before = F.col(before) if isinstance(before, str) else before
    users = F.col(users) if isinstance(users, str) else users
    return ratio(before - users, before)


def stage_table(counts: DataFrame, stages: list[str]) -> DataFrame:
    """Stages of a one-row frame with one count column per stage, as rows.

    Each stage carries the count before it, so no ordering over rows is
    needed. A growing stage has a negative drop-off.
    """
    rows = [F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"),
                     F.col(f"`{name}`").alias("users"), F.col(f"`{stages[0]}`").alias("total"),
                     F.col(f"`{stages[max(i - 1, 0)]}`").alias("before"))
            for i, name in enumerate(stages)]
    return (counts.select(F.inline(F.array(*rows)))
            .select("stage_no", "stage", "users", ratio("users", "total").alias("conversion_rate"),
                    _drop("before", "users").alias("drop_off_rate")))


def biggest_drop(stages: list[str]) -> Column:
    """Name of the stage with the largest positive drop, the first on a tie."""
    drops = [F.struct(_drop(f"`{a}`", f"`{b}`").alias("drop"), F.lit(-i).alias("order"),
                      F.lit(b).alias("stage"))
             for i, (a, b) in enumerate(zip(stages, stages[1:]))]
    top = F.array_max(F.array(*drops))
    return F.when(top["drop"] > 0, top["stage"]).otherwise("unknown")


def recommendations(counts: DataFrame, stages: list[str]) -> DataFrame:
    """Advice per stage that loses more than a fifth, and on tracks 3 to 5."""
    advice = []
    for a, b in zip(stages, stages[1:]):
        drop = _drop(f"`{a}`", f"`{b}`")
        advice.append(F.when(drop > STAGE_LIMIT, F.format_string(STAGE_ADVICE, drop * 100, F.lit(b))))
    if "track_3_complete" in stages and "track_5_complete" in stages:
        drop = _drop("track_3_complete", "track_5_complete")
        advice.append(F.when(drop > TRACK_LIMIT, F.format_string(TRACK_ADVICE, drop * 100)))
    given = F.array_compact(F.array(*advice))
    shown = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(HEALTHY_ADVICE)))
    return counts.select(F.posexplode(shown).alias("position", "recommendation"))


# --- playlist completion ----------------------------------------------------

def playlist_day_funnel(sessions: DataFrame, low_skip: float = 0.2) -> DataFrame:
    """Playlist days of users: started, 3+ and 5+ plays, few skips."""
    days = (sessions.where(F.col("context") == "playlist")
            .groupBy("user_id", F.to_date("timestamp").alias("day"))
            .agg(F.count("*").alias("played"), F.count_if("skipped").alias("skips")))
    stages = {
        "Started Playlist": F.lit(True),
        "Played 3+ Tracks": F.col("played") >= 3,
        "Played 5+ Tracks": F.col("played") >= 5,
        "Low Skip Rate (<20%)": ratio("skips", "played", None) < low_skip,
    }
    counts = days.agg(*(F.count_if(c).alias(n) for n, c in stages.items()))
    return stage_table(counts, list(stages)).select("stage", "users")


def playlist_progress(sessions: DataFrame, playlist_length: int = 20,
                      playlist_tracks: DataFrame | None = None) -> DataFrame:
    """Playlist listening per user and day: finished tracks and share of the list.

    With a ``playlist_id`` on the plays and the playlist contents, each
    playlist counts on its own with its own length; otherwise all playlist
    plays of a day are one run of ``playlist_length`` tracks.
    """
    keys = ["user_id", F.to_date("timestamp").alias("day")]
    by_list = playlist_tracks is not None and "playlist_id" in sessions.columns
    if by_list:
        keys.append("playlist_id")
    runs = (sessions.where(F.col("context") == "playlist").groupBy(*keys)
            .agg(F.count_if(skip_flag() == 0).alias("tracks_completed")))
    if by_list:
        lengths = playlist_tracks.groupBy("playlist_id").agg(F.count("*").alias("playlist_length"))
        runs = runs.join(lengths, "playlist_id", "left")
    else:
        runs = runs.withColumn("playlist_length", F.lit(playlist_length).cast("bigint"))
    return runs.withColumn("completion_ratio",
                           clip(ratio("tracks_completed", "playlist_length", None), 0, 1))


def completion_counts(progress: DataFrame) -> DataFrame:
    """One row, one count per completion stage, in one pass."""
    def reached(rule):
        return F.lit(True) if rule is None else F.col(rule[0]) >= rule[1]
    return progress.agg(*(F.count_if(reached(rule)).alias(name)
                          for name, rule in COMPLETION_STAGES.items()))


def completion_funnel(progress: DataFrame) -> DataFrame:
    return stage_table(completion_counts(progress), list(COMPLETION_STAGES))


def completion_metrics(progress: DataFrame) -> DataFrame:
    """One row of headline numbers of the completion funnel."""
    def share(stage):
        return ratio(f"`{stage}`", "started")
    return completion_counts(progress).select(
        F.col("started").alias("total_playlist_starts"),
        share("100_percent_complete").alias("overall_completion_rate"),
        share("track_1_complete").alias("track_1_completion"),
        share("track_3_complete").alias("track_3_completion"),
        share("track_5_complete").alias("track_5_completion"),
        _drop("track_1_complete", "track_3_complete").alias("drop_off_track_1_3"),
        _drop("track_3_complete", "track_5_complete").alias("drop_off_track_3_5"),
        biggest_drop(list(COMPLETION_STAGES)).alias("biggest_drop_off_stage"))


# --- activation -------------------------------------------------------------

def activation_counts(users: DataFrame, sessions: DataFrame, iso_week_only: bool = False,
                      week_plays: int = 2, fortnight_plays: int = 3,
                      least_weeks: int = 4) -> DataFrame:
    """One row, one count per activation stage.

    "k plays within d days of the first" holds exactly if the k-th earliest
    play is within d days. So only the few earliest plays of a user are kept;
    Spark limits them per map task before the shuffle, whatever a user's total.
    Weeks are calendar weeks; ``iso_week_only`` counts week numbers regardless
    of the year.
    """
    plays = sessions.select("user_id", "timestamp").where(F.col("user_id").isNotNull())
    order = Window.partitionBy("user_id").orderBy("timestamp")
    keep = max(week_plays, fortnight_plays)
    earliest = (plays.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
                .groupBy("user_id")
                .agg(F.min("timestamp").alias("first_session"),
                     F.max(F.when(F.col("nth") == week_plays, F.col("timestamp"))).alias("for_week"),
                     F.max(F.when(F.col("nth") == fortnight_plays, F.col("timestamp"))).alias("for_two")))
    first = F.col("first_session")
    by_user = earliest.agg(
        F.count("*").alias("first_session"),
        F.count_if(F.col("for_week") <= first + F.expr("interval 7 days")).alias("active_week_1"),
        F.count_if(F.col("for_two") <= first + F.expr("interval 14 days")).alias("retained_week_2"))
    week = F.weekofyear("timestamp") if iso_week_only else period_start("timestamp", "weekly")
    weeks = (plays.select("user_id", week.alias("week")).distinct()
             .groupBy("user_id").agg(F.count("week").alias("weeks"))
             .agg(F.count_if(F.col("weeks") >= least_weeks)))
    signed = (users.select("user_id", "signup_date")
              .join(earliest.select("user_id", "first_session"), "user_id", "left")
              .agg(F.struct(F.count("*").alias("users"),
                            F.count_if(floor_days("first_session", "signup_date") <= 1)
                            .alias("day_1"))).scalar())
    return by_user.select(signed["users"].alias("signed_up"), "first_session",
                          signed["day_1"].alias("activated_day_1"), "active_week_1",
                          "retained_week_2", weeks.scalar().alias("weekly_active"))


def activation_funnel(users: DataFrame, sessions: DataFrame, **options) -> DataFrame:
    return stage_table(activation_counts(users, sessions, **options), ACTIVATION_STAGES)


def activation_rates(users: DataFrame, sessions: DataFrame, **options) -> DataFrame:
    """One row: share of signups reaching each stage."""
    def share(stage):
        return ratio(stage, "signed_up")
    return activation_counts(users, sessions, **options).select(
        F.col("signed_up").alias("total_signups"),
        share("first_session").alias("first_session_rate"),
        share("activated_day_1").alias("day_1_activation_rate"),
        share("active_week_1").alias("week_1_retention_rate"),
        share("retained_week_2").alias("week_2_retention_rate"),
        share("weekly_active").alias("weekly_active_rate"),
        share("weekly_active").alias("signup_to_active_conversion"))


# --- ordered events ---------------------------------------------------------

def event_counts(events: DataFrame, stages: list[str], user: str = "user_id", ts: str = "ts",
                 event: str = "event_type") -> DataFrame:
    """One row: users who did the stages in order, each at or after the one before.

    One inner join per stage against the users still in, of whom only the
    earliest fitting time is kept.
    """
    def of(name):
        return events.where(F.col(event) == name).select(F.col(user).alias("who"), F.col(ts).alias("at"))

    reached = of(stages[0]).groupBy("who").agg(F.min("at").alias("since"))
    counts = [reached.agg(F.count("*")).scalar()]
    for name in stages[1:]:
        reached = (of(name).join(reached, "who").where(F.col("at") >= F.col("since"))
                   .groupBy("who").agg(F.min("at").alias("since")))
        counts.append(reached.agg(F.count("*")).scalar())
    one_row = events.sparkSession.range(1)
    return one_row.select(*(c.alias(n) for c, n in zip(counts, stages)))


def event_funnel(events: DataFrame, stages: list[str], **columns: str) -> DataFrame:
    return stage_table(event_counts(events, stages, **columns), stages)
