"""Per-user behaviour features.

Each group is a function of its own; :func:`user_features` builds them all.
Plain aggregates of all groups share a single ``groupBy("user_id")``. What
needs a finer grain first (days, genres, distinct ids) is aggregated at that
grain before it is grouped by user. Where that leaves next to nothing
aggregated in the map tasks, plays are dealt by user first, but for heavy
users: no more of a user's plays ever meet in one task than a task should hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions.numbers import clip, mapped, ratio, share_entropy
from earshot.functions.times import floor_days, hour_of, is_weekend, part_hours
from earshot.plans.calendar import active_days, dates_of
from earshot.plans.heavy import dealt, key_sizes
from earshot.plans.stored import stored

# The measures with preference features, and category codes.
PREFERENCE_AUDIO = ["tempo", "energy", "danceability", "valence", "acousticness"]
TIER_CODES = {"free": 0, "student": 1, "premium": 2, "family": 3}
AGE_CODES = {"18-24": 0, "25-34": 1, "35-44": 2, "45-54": 3, "55+": 4}
DEFAULT_TIER, DEFAULT_AGE, DEFAULT_COUNTRY_SHARE = 0, 1, 0.1

# The feature catalogue by group.
FEATURE_GROUPS = {
    "streak_features": ["current_streak", "max_streak", "avg_streak", "streak_count",
                        "active_days", "active_days_ratio"],
    "genre_features": ["genre_entropy", "genre_count", "top_genre_ratio",
                       "genre_exploration_rate", "genre_concentration"],
    "playlist_features": ["playlist_session_ratio", "playlist_track_count",
                          "playlist_skip_rate", "playlist_completion_tendency"],
    "session_features": ["total_listen_time_ms", "avg_listen_duration_ms",
                         "std_listen_duration_ms", "skip_rate", "total_skips", "session_count",
                         "unique_tracks", "avg_listen_ratio", "total_listen_hours"],
    "temporal_features": ["night_ratio", "morning_ratio", "afternoon_ratio", "evening_ratio",
                          "weekend_ratio", "peak_hour", "hour_entropy"],
    "audio_features": ["avg_tempo_pref", "tempo_variance", "avg_energy_pref", "energy_variance",
                       "avg_danceability_pref", "danceability_variance", "avg_valence_pref",
                       "valence_variance", "avg_acousticness_pref", "acousticness_variance",
                       "high_energy_ratio", "mellow_music_ratio"],
    "engagement_features": ["days_since_first_listen", "days_since_last_listen",
                            "avg_daily_sessions", "engagement_score", "total_events"],
    "demographic_features": ["tier_encoded", "age_group_encoded", "country_frequency"],
}


def feature_groups() -> dict[str, list[str]]:
    """Feature names by group."""
    return {group: list(names) for group, names in FEATURE_GROUPS.items()}


def _known(df: DataFrame) -> DataFrame:
    return df.where(F.col("user_id").isNotNull())


def _flag() -> Column:
    return F.col("skipped").cast("double")


def with_tracks(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays with genre and audio of their track; unknown tracks stay, unset."""
    return sessions.join(tracks.select("track_id", "genre", *PREFERENCE_AUDIO), "track_id", "left")


# --- listening streaks ------------------------------------------------------

def streaks(sessions: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Runs of consecutive listening days; the last run is the current one.

    Plays become one row per user and month before they are shuffled. A user's months, which a calendar bounds, become days
    inside the row; no task sorts days.
    """
    months = (active_days(_known(sessions), ts).groupBy("user_id")
              .agg(F.sort_array(F.collect_list(F.struct("month", "days"))).alias("months")))
    return months.withColumn("active", dates_of("months")).select("user_id", *(c.alias(name) for name, c in _streak_columns().items()))


# --- genre diversity --------------------------------------------------------

def genre_diversity(plays: DataFrame) -> DataFrame:
    """Entropy, number, top share, rare share and concentration of a user's genres."""
    counts = (_known(plays).where(F.col("genre").isNotNull())
              .groupBy("user_id", "genre").agg(F.count("*").alias("n")))
    mine = Window.partitionBy("user_id")  # one row per genre
    share = F.col("share")
    return (counts.withColumn("share", F.col("n") / F.sum("n").over(mine))
            .groupBy("user_id")
            .agg(F.sum(share_entropy(share)).alias("genre_entropy"),
                 F.count("*").alias("genre_count"), F.max(share).alias("top_genre_ratio"),
                 F.when(F.count("*") > 1, F.avg((share < 0.05).cast("double")))
                 .otherwise(0.0).alias("genre_exploration_rate"),
                 F.sum(share * share).alias("genre_concentration")))


# --- groups that are plain aggregates ---------------------------------------
# Each has the aggregates it needs and the columns it makes of them.

def _playlist_aggregates() -> list[Column]:
    listed = F.col("context") == "playlist"
    return [F.count("*").alias("total_events"), F.count_if(listed).alias("playlist_track_count"),
            F.avg(F.when(listed, _flag())).alias("listed_skips")]


def _playlist_columns() -> dict[str, Column]:
    skips = F.coalesce("listed_skips", F.lit(0.0))
    return {"playlist_session_ratio": ratio("playlist_track_count", "total_events"),
            "playlist_track_count": F.col("playlist_track_count"),
            "playlist_skip_rate": skips, "playlist_completion_tendency": 1 - skips}


def playlist_behavior(sessions: DataFrame) -> DataFrame:
    return _finish(_known(sessions).groupBy("user_id").agg(*_playlist_aggregates()), _playlist_columns())


def _listening_aggregates() -> list[Column]:
    return [F.sum("listen_duration_ms").alias("total_listen_time_ms"),
            F.avg("listen_duration_ms").alias("avg_listen_duration_ms"),
            F.stddev_samp("listen_duration_ms").alias("std_listen_duration_ms"),
            F.avg("track_duration_ms").alias("avg_track_duration_ms"),
            F.avg(_flag()).alias("skip_rate"), F.count_if("skipped").alias("total_skips")]


def _listening_columns() -> dict[str, Column]:
    return {**{name: F.col(name) for name in
               ("total_listen_time_ms", "avg_listen_duration_ms", "std_listen_duration_ms",
                "avg_track_duration_ms", "skip_rate", "total_skips", "session_count", "unique_tracks")},
            "avg_listen_ratio": clip(ratio("avg_listen_duration_ms", "avg_track_duration_ms", None), 0, 1),
            "avg_tracks_per_session": ratio("total_events", "session_count", None),
            "total_listen_hours": F.col("total_listen_time_ms") / 3_600_000}


def _distinct_ids(sessions: DataFrame) -> DataFrame:
    """Distinct sessions and tracks per user over a narrow projection."""
    return (_known(sessions).groupBy("user_id")
            .agg(F.countDistinct("session_id").alias("session_count"),
                 F.countDistinct("track_id").alias("unique_tracks")))


def listening(sessions: DataFrame) -> DataFrame:
    """Time, skips, distinct sessions and tracks, ratio of listened to track length."""
    base = _known(sessions).groupBy("user_id").agg(F.count("*").alias("total_events"),
                                                   *_listening_aggregates())
    return _finish(base.join(_distinct_ids(sessions), "user_id"), _listening_columns())


def _audio_aggregates() -> list[Column]:
    lively = F.coalesce(F.col("energy") > 0.7, F.lit(False))
    mellow = F.coalesce((F.col("energy") < 0.4) & (F.col("acousticness") > 0.5), F.lit(False))
    out = []
    for name in PREFERENCE_AUDIO:
        out += [F.avg(name).alias(f"avg_{name}_pref"),
                F.coalesce(F.stddev_samp(name), F.lit(0.0)).alias(f"{name}_variance")]
    return out + [F.avg(lively.cast("double")).alias("high_energy_ratio"),
                  F.avg(mellow.cast("double")).alias("mellow_music_ratio")]


def _audio_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in FEATURE_GROUPS["audio_features"]}


def audio_preferences(plays: DataFrame) -> DataFrame:
    """Mean and spread of the audio of what a user plays.

    The ``*_variance`` columns hold standard deviations; the name is the
    established one.
    """
    return _finish(_known(plays).groupBy("user_id").agg(*_audio_aggregates()), _audio_columns())


def _engagement_aggregates() -> list[Column]:
    return [F.min("timestamp").alias("first_listen"), F.max("timestamp").alias("last_listen"),
            F.count("timestamp").alias("timed_events")]


def _engagement_columns() -> dict[str, Column]:
    now = F.col("now")
    since_last = floor_days(now, "last_listen")
    span = floor_days("last_listen", "first_listen") + 1
    daily = clip(ratio("timed_events", span, None), 0, 100)
    recency = 1 - clip(since_last / 365, 0, 1)
    frequency = clip(daily / 10, 0, 1)
    volume = clip(F.log1p(F.col("timed_events").cast("double")) / 10, 0, 1)
    return {"days_since_first_listen": floor_days(now, "first_listen"),
            "days_since_last_listen": since_last, "avg_daily_sessions": daily,
            "engagement_score": recency * 0.3 + frequency * 0.4 + volume * 0.3,
            "total_events": F.col("timed_events")}


def _last_play(sessions: DataFrame) -> Column:
    return sessions.agg(F.max("timestamp")).scalar()


def engagement(sessions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Recency, frequency, volume and their weighted score. "Now" is the last play."""
    now = _last_play(sessions) if as_of is None else as_of
    return _finish(_known(sessions).groupBy("user_id").agg(*_engagement_aggregates()).withColumn("now", now),
                   _engagement_columns())


def _timed(plays: DataFrame) -> DataFrame:
    return plays.withColumn("hour", hour_of("timestamp")).withColumn("weekend", is_weekend("timestamp"))


def _temporal_aggregates() -> list[Column]:
    """One counter per hour of the day: a histogram without a shuffle of its own."""
    counters = ", ".join(f"count_if(hour = {h})" for h in range(24))
    return [F.expr(f"array({counters})").alias("by_hour"), F.expr("count_if(weekend)").alias("weekend_plays"),
            F.count("hour").alias("hours")]


def _temporal_columns() -> dict[str, Column]:
    """Shares per part of the day and weekend, peak hour (the first on a tie), entropy."""
    parts = {f"{name}_ratio": ratio(F.expr(
        f"aggregate(slice(by_hour, {first + 1}, {last - first + 1}), 0L, (a, n) -> a + n)"), "hours")
        for name, (first, last) in part_hours().items()}
    return {**parts, "weekend_ratio": ratio("weekend_plays", "hours"),
            "peak_hour": F.expr("cast(array_position(by_hour, array_max(by_hour)) - 1 as int)"),
            "hour_entropy": F.expr("aggregate(by_hour, 0D, (a, n) -> "
                                   "a - if(n > 0, n / hours * log2(n / hours), 0D))")}


def temporal(sessions: DataFrame) -> DataFrame:
    """When a user listens."""
    return _finish(_timed(_known(sessions)).groupBy("user_id").agg(*_temporal_aggregates()), _temporal_columns())


def _finish(base: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return base.select("user_id", *(c.alias(name) for name, c in columns.items()))


# --- demographics -----------------------------------------------------------

def encode_demographics(features: DataFrame, country_share: DataFrame | None = None) -> DataFrame:
    """Add tier_encoded, age_group_encoded and country_frequency.

    ``country_share`` (country, country_frequency) defaults to the shares
    among the rows themselves, rows without a country left out.
    """
    if country_share is None:
        country_share = country_shares(features)
    return (features.join(country_share, "country", "left")
            .withColumn("tier_encoded", mapped("tier", TIER_CODES, DEFAULT_TIER))
            .withColumn("age_group_encoded", mapped("age_group", AGE_CODES, DEFAULT_AGE))
            .withColumn("country_frequency",
                        F.coalesce("country_frequency", F.lit(DEFAULT_COUNTRY_SHARE))))


def country_shares(rows: DataFrame) -> DataFrame:
    everything = F.sum("n").over(Window.partitionBy())  # over one row per country
    return (rows.where(F.col("country").isNotNull()).groupBy("country").agg(F.count("*").alias("n"))
            .select("country", (F.col("n") / everything).alias("country_frequency")))


# --- all features -----------------------------------------------------------

def _grains(plays: DataFrame) -> DataFrame:
    """One row per user: months with their active days as bits, plays per genre, distinct tracks and sessions.

    Each play is expanded into one narrow row per grain (user and month, genre, track, session). All grains are aggregated
    together where the plays lie, and gathered by user; what is gathered is bounded by calendar and genres. Between the two
    they are shuffled once, or not at all where the plays are dealt by user.
    """
    grains = {"month": (F.trunc(F.to_date("timestamp"), "month"), F.expr("shiftleft(1L, dayofmonth(to_date(timestamp)))")),
              "genre": (F.col("genre"), F.lit(0).cast("bigint")), "track_id": (F.col("track_id"), F.lit(0).cast("bigint")),
              "session_id": (F.col("session_id"), F.lit(0).cast("bigint"))}
    kinds = {"month": "date", **{c: plays.schema[c].dataType for c in ("genre", "track_id", "session_id")}}
    rows = [F.struct(F.lit(name).alias("grain"), *((value if c == name else F.lit(None).cast(kinds[c])).alias(c) for c in grains), bit.alias("bit"))
            for name, (value, bit) in grains.items()]
    tagged = _known(plays).select("user_id", F.inline(F.array(*rows))).where(F.coalesce(*(F.col(c).cast("string") for c in grains)).isNotNull())
    grouped = tagged.groupBy("user_id", "grain", *grains).agg(F.count("*").alias("n"), F.bit_or("bit").alias("days"))

    def of(grain, value):
        return F.when(F.col("grain") == grain, value)
    return grouped.groupBy("user_id").agg(
        F.sort_array(F.collect_list(of("month", F.struct("month", "days")))).alias("months"), F.collect_list(of("genre", F.col("n"))).alias("genres"),
        F.count_if(F.col("grain") == "track_id").alias("unique_tracks"), F.count_if(F.col("grain") == "session_id").alias("session_count"))


def _streak_columns() -> dict[str, Column]:
    """Streaks from ``active``, the sorted array of active days."""
    days, n = F.col("active"), F.size("active")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.datediff(F.get(days, i), F.get(days, i - 1)) > 1, F.lit(True)))
    lengths = F.zip_with(first, F.concat(F.slice(first, 2, F.size(first)), F.array(n)), lambda a, z: z - a)
    some = n > 0
    columns = {"current_streak": F.element_at(lengths, -1).cast("bigint"), "max_streak": F.array_max(lengths).cast("bigint"),
               "avg_streak": n / F.size(first), "streak_count": F.size(first).cast("bigint"), "active_days": n.cast("bigint"),
               "active_days_ratio": n / (F.datediff(F.element_at(days, -1), F.get(days, F.lit(0))) + 1)}
    return {name: F.when(some, c) for name, c in columns.items()}


def _genre_columns() -> dict[str, Column]:
    """Genre diversity from ``genres``, the plays of each; the same as :func:`genre_diversity` makes by windows."""
    def added(values):
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate("genres", F.lit(0).cast("bigint"), lambda a, x: a + x)
    shares = F.transform("genres", lambda n: n / total)
    n = F.size("genres")
    rare = added(F.transform(shares, lambda s: (s < 0.05).cast("double"))) / n
    columns = {"genre_entropy": added(F.transform(shares, share_entropy)), "genre_count": n.cast("bigint"), "top_genre_ratio": F.array_max(shares),
               "genre_exploration_rate": F.when(n > 1, rare).otherwise(0.0), "genre_concentration": added(F.transform(shares, lambda s: s * s))}
    return {name: F.when(n > 0, c) for name, c in columns.items()}


def _listener_countries(sessions: DataFrame, demographics: DataFrame, as_of: Column | None) -> DataFrame:
    """One row per country of listeners, null included: its share among known ones, and the time that counts as now."""
    last = sessions.groupBy("user_id").agg(F.max("timestamp").alias("last"))
    by_country = (last.join(demographics.select("user_id", "country"), "user_id", "left").groupBy("country")
                  .agg(F.count("*").alias("n"), F.max("last").alias("last")))
    whole = Window.partitionBy()  # over one row per country
    known = F.when(F.col("country").isNotNull(), F.col("n"))
    now = F.max("last").over(whole) if as_of is None else as_of
    return by_country.select(F.col("country").alias("_country"), (known / F.sum(known).over(whole)).alias("country_frequency"), now.alias("now"))


def _own_features(plays: DataFrame) -> DataFrame:
    """One row per user: plain aggregates of the plays, and their grains."""
    base = _timed(_known(plays)).groupBy("user_id").agg(
        *_playlist_aggregates(), *_listening_aggregates(), *_audio_aggregates(),
        *_temporal_aggregates(), *_engagement_aggregates())
    return base.join(_grains(plays), "user_id", "left")


def user_features(sessions: DataFrame, users: DataFrame, tracks: DataFrame,
                  as_of: Column | None = None) -> DataFrame:
    """All groups, demographics and their encodings; missing numbers become 0.

    Plays meet their tracks once and are stored; they are read three times: for plain aggregates by user, for the finer grains,
    and for the last play of each listener, which gives the shares of countries and "now". The first two deal the plays by user
    before they aggregate, as a map task would see few plays of a user and pass on most rows, each wider than the plays
    behind it. Only plays of heavy users are aggregated where they lie. All branches end hash-partitioned by user, so joining
    them adds no shuffle.
    """
    listed = F.when(F.col("context") == "playlist", F.col("context")).alias("context")  # of others only that they are none
    plays = stored(with_tracks(sessions, tracks).select(
        "user_id", "session_id", "track_id", "timestamp", "listen_duration_ms", "track_duration_ms", "skipped", listed, "genre", *PREFERENCE_AUDIO), "plays-with-tracks")
    sizes = key_sizes(_known(plays), "user_id")
    light = plays.where(~sizes.is_heavy("user_id")) if sizes.heavy else plays
    own = _own_features(dealt(_known(light), "user_id", sizes.rows))
    if sizes.heavy:
        own = own.unionByName(_own_features(plays.where(sizes.is_heavy("user_id"))))
    demographics = users.select("user_id", "tier", "country", "age_group")
    wide = own.join(demographics, "user_id", "left")
    told = wide.join(_listener_countries(plays, demographics, as_of), F.col("country").eqNullSafe(F.col("_country")), "left")
    told = told.withColumns({"active": dates_of("months"), "unique_tracks": F.coalesce("unique_tracks", F.lit(0)), "session_count": F.coalesce("session_count", F.lit(0))})
    columns = {**_playlist_columns(), **_listening_columns(), **_audio_columns(), **_temporal_columns(), **_engagement_columns(),
               **_streak_columns(), **_genre_columns()}
    names = [n for group in list(FEATURE_GROUPS)[:-1] for n in FEATURE_GROUPS[group]]
    names += ["avg_track_duration_ms", "avg_tracks_per_session"]
    return told.select("user_id", *(F.coalesce(columns[n], F.lit(0)).alias(n) for n in names), "tier", "country", "age_group",
                       F.coalesce("country_frequency", F.lit(DEFAULT_COUNTRY_SHARE)).alias("country_frequency"),
                       mapped("tier", TIER_CODES, DEFAULT_TIER).alias("tier_encoded"), mapped("age_group", AGE_CODES, DEFAULT_AGE).alias("age_group_encoded"))


# --- model inputs -----------------------------------------------------------

def forecast_features(sessions: DataFrame) -> DataFrame:
    """Per user: spread, range, count, skip rate, hour, weekend share; target avg_duration."""
    return _known(sessions).groupBy("user_id").agg(
        F.avg("listen_duration_ms").alias("avg_duration"),
        F.stddev_samp("listen_duration_ms").alias("std_duration"),
        F.min("listen_duration_ms").alias("min_duration"),
        F.max("listen_duration_ms").alias("max_duration"),
        F.count("listen_duration_ms").alias("session_count"), F.avg(_flag()).alias("skip_rate"),
        F.avg(hour_of("timestamp")).alias("avg_hour"),
        F.avg(is_weekend("timestamp").cast("double")).alias("weekend_ratio"))


def duration_features(sessions: DataFrame) -> DataFrame:
    """The short feature set of the duration model, gaps filled with 0."""
    return _known(sessions).groupBy("user_id").agg(
        F.count("listen_duration_ms").alias("session_count"),
        F.coalesce(F.stddev_samp("listen_duration_ms"), F.lit(0.0)).alias("duration_std"),
        F.coalesce(F.avg(_flag()), F.lit(0.0)).alias("skip_rate"),
        F.avg(hour_of("timestamp")).alias("avg_hour"),
        F.avg("listen_duration_ms").alias("avg_duration"))


def experiment_metrics(sessions: DataFrame) -> DataFrame:
    """Per user: plays, skip rate and listening time, the usual test metrics."""
    return _known(sessions).groupBy("user_id").agg(
        F.count("*").alias("total_sessions"), F.avg(_flag()).alias("skip_rate"),
        F.sum("listen_duration_ms").alias("total_listen_time"))
