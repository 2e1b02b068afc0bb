"""User and play features."""

from __future__ import annotations

from earshot.operators import features as fe, sessionize as sz, skip_features as sk
from earshot.schemas import AUDIO
from registry.base import SKIPD, query

ENTROPY = "-sum({p} * log2({p}))"


def streak_sql(source: str, ts: str) -> str:
    return f"""
select user_id, max(case when r = 1 then length end) as current_streak, max(length) as max_streak, avg(length) as avg_streak,
 count(*) as streak_count, sum(length) as active_days,
 sum(length) * 1e0 / (date_diff('day', min(first), max(last)) + 1) as active_days_ratio
from (select *, row_number() over (partition by user_id order by last desc) as r
  from (select user_id, island, count(*) as length, min(day) as first, max(day) as last
    from (select user_id, day, day - cast(row_number() over (partition by user_id order by day) as int) as island
      from (select distinct user_id, cast({ts} as date) as day from {source}) d) i group by 1, 2) g) h
group by user_id"""


STREAKS = "current_streak:i, max_streak:i, avg_streak:d, streak_count:i, active_days:i, active_days_ratio:d"
GENRES = "genre_entropy:d, genre_count:i, top_genre_ratio:d, genre_exploration_rate:d, genre_concentration:d"
PLAYLIST = "playlist_session_ratio:d, playlist_track_count:i, playlist_skip_rate:d, playlist_completion_tendency:d"
LISTENING = ("total_listen_time_ms:i, avg_listen_duration_ms:d, std_listen_duration_ms:d, avg_track_duration_ms:d, "
             "skip_rate:d, total_skips:i, session_count:i, unique_tracks:i, avg_listen_ratio:d, "
             "avg_tracks_per_session:d, total_listen_hours:d")
TEMPORAL = "night_ratio:d, morning_ratio:d, afternoon_ratio:d, evening_ratio:d, weekend_ratio:d, peak_hour:i, hour_entropy:d"
AUDIO_PREFS = ", ".join(f"avg_{a}_pref:d, {a}_variance:d" for a in fe.PREFERENCE_AUDIO) + ", high_energy_ratio:d, mellow_music_ratio:d"
ENGAGEMENT = "days_since_first_listen:i, days_since_last_listen:i, avg_daily_sessions:d, engagement_score:d, total_events:i"

GENRES_SQL = f"""
select user_id, case when count(*) > 1 then {ENTROPY.format(p='p')} else 0 end as genre_entropy, count(*) as genre_count,
 max(p) as top_genre_ratio, case when count(*) > 1 then avg(case when p < 0.05 then 1e0 else 0e0 end) else 0 end as genre_exploration_rate,
 sum(p * p) as genre_concentration
from (select user_id, genre, n * 1e0 / sum(n) over (partition by user_id) as p
  from (select s.user_id, t.genre, count(*) as n from sessions s join tracks t on s.track_id = t.track_id
    where t.genre is not null group by 1, 2) c) g group by 1"""

PLAYLIST_SQL = f"""
select user_id, count(*) filter (context = 'playlist') * 1e0 / count(*) as playlist_session_ratio,
 count(*) filter (context = 'playlist') as playlist_track_count,
 coalesce(avg({SKIPD}) filter (context = 'playlist'), 0) as playlist_skip_rate,
 1 - coalesce(avg({SKIPD}) filter (context = 'playlist'), 0) as playlist_completion_tendency
from sessions group by 1"""

LISTENING_SQL = f"""
select user_id, sum(listen_duration_ms) as total_listen_time_ms, avg(listen_duration_ms) as avg_listen_duration_ms,
 stddev_samp(listen_duration_ms) as std_listen_duration_ms, avg(track_duration_ms) as avg_track_duration_ms,
 avg({SKIPD}) as skip_rate, sum(cast(skipped as int)) as total_skips, count(distinct session_id) as session_count,
 count(distinct track_id) as unique_tracks,
 least(greatest(avg(listen_duration_ms) / avg(track_duration_ms), 0), 1) as avg_listen_ratio,
 count(*) * 1e0 / count(distinct session_id) as avg_tracks_per_session,
 sum(listen_duration_ms) / 3600000.0e0 as total_listen_hours from sessions group by 1"""

TEMPORAL_SQL = f"""
select a.user_id, night_ratio, morning_ratio, afternoon_ratio, evening_ratio, weekend_ratio, peak_hour, hour_entropy
from (select user_id, avg(case when extract(hour from timestamp) <= 6 then 1e0 else 0e0 end) as night_ratio,
  avg(case when extract(hour from timestamp) between 7 and 12 then 1e0 else 0e0 end) as morning_ratio,
  avg(case when extract(hour from timestamp) between 13 and 18 then 1e0 else 0e0 end) as afternoon_ratio,
  avg(case when extract(hour from timestamp) >= 19 then 1e0 else 0e0 end) as evening_ratio,
  avg(case when extract(isodow from timestamp) >= 6 then 1e0 else 0e0 end) as weekend_ratio from sessions group by 1) a
join (select user_id, {ENTROPY.format(p='p')} as hour_entropy, max(case when r = 1 then hour end) as peak_hour
  from (select user_id, hour, n * 1e0 / sum(n) over (partition by user_id) as p,
     row_number() over (partition by user_id order by n desc, hour) as r
    from (select user_id, extract(hour from timestamp) as hour, count(*) as n from sessions group by 1, 2) c) h group by 1) b
on a.user_id = b.user_id"""

AUDIO_SQL = "select s.user_id, " + ", ".join(
    f"avg({a}) as avg_{a}_pref, coalesce(stddev_samp({a}), 0) as {a}_variance" for a in fe.PREFERENCE_AUDIO) + """,
 avg(case when energy > 0.7 then 1e0 else 0e0 end) as high_energy_ratio,
 avg(case when energy < 0.4 and acousticness > 0.5 then 1e0 else 0e0 end) as mellow_music_ratio
from sessions s left join tracks t on s.track_id = t.track_id group by 1"""

ENGAGEMENT_SQL = """
select user_id, days_since_first_listen, days_since_last_listen, daily as avg_daily_sessions,
 (1 - least(days_since_last_listen / 365.0e0, 1)) * 0.3e0 + least(daily / 10, 1) * 0.4e0 + least(ln(1 + n) / 10, 1) * 0.3e0 as engagement_score,
 n as total_events
from (select user_id, n, cast(floor(date_diff('second', f, now) / 86400.0e0) as bigint) as days_since_first_listen,
  cast(floor(date_diff('second', l, now) / 86400.0e0) as bigint) as days_since_last_listen,
  least(n * 1e0 / (floor(date_diff('second', f, l) / 86400.0e0) + 1), 100) as daily
 from (select user_id, min(timestamp) as f, max(timestamp) as l, count(*) as n from sessions group by 1) u,
  (select max(timestamp) as now from sessions) x) y"""

UID = "user_id:i, "


@query("streak_features", UID + STREAKS, sql=streak_sql("sessions", "timestamp"))
def streak_features(m):
    return fe.streaks(m.sessions)


@query("streak_features_events", UID + STREAKS, uses="", sql=streak_sql("events", "ts"))
def streak_features_events(m):
    return fe.streaks(m.events, ts="ts")


@query("genre_features", UID + GENRES, uses="sessions tracks", sql=GENRES_SQL)
def genre_features(m):
    return fe.genre_diversity(fe.with_tracks(m.sessions, m.tracks))


@query("playlist_features", UID + PLAYLIST, sql=PLAYLIST_SQL)
def playlist_features(m):
    return fe.playlist_behavior(m.sessions)


@query("session_features", UID + LISTENING, sql=LISTENING_SQL)
def session_features(m):
    return fe.listening(m.sessions)


@query("temporal_features", UID + TEMPORAL, sql=TEMPORAL_SQL)
def temporal_features(m):
    return fe.temporal(m.sessions)


@query("audio_features", UID + AUDIO_PREFS, uses="sessions tracks", sql=AUDIO_SQL)
def audio_features(m):
    return fe.audio_preferences(fe.with_tracks(m.sessions, m.tracks))


@query("engagement_features", UID + ENGAGEMENT, sql=ENGAGEMENT_SQL)
def engagement_features(m):
    return fe.engagement(m.sessions)


DEMOGRAPHICS = """
select {k}.user_id, u.tier, u.country, u.age_group,
 case u.tier when 'free' then 0 when 'student' then 1 when 'premium' then 2 when 'family' then 3 else 0 end as tier_encoded,
 case u.age_group when '18-24' then 0 when '25-34' then 1 when '35-44' then 2 when '45-54' then 3 when '55+' then 4 else 1 end as age_group_encoded,
 coalesce(count(*) over (partition by u.country) * 1e0 / sum(case when u.country is not null then 1 else 0 end) over (), 0.1) as country_frequency
from {src} {k} left join users u on {k}.user_id = u.user_id"""
DEMO = "tier, country, age_group, tier_encoded:i, age_group_encoded:i, country_frequency:d"


@query("demographic_features", UID + DEMO, uses="users", sql=DEMOGRAPHICS.format(src="users", k="x"))
def demographic_features(m):
    return fe.encode_demographics(m.users).select(*("user_id tier country age_group tier_encoded age_group_encoded country_frequency".split()))


_GROUPS = {"st": (STREAKS, streak_sql("sessions", "timestamp")), "ge": (GENRES, GENRES_SQL), "pl": (PLAYLIST, PLAYLIST_SQL),
           "li": (LISTENING, LISTENING_SQL), "te": (TEMPORAL, TEMPORAL_SQL), "au": (AUDIO_PREFS, AUDIO_SQL), "en": (ENGAGEMENT, ENGAGEMENT_SQL)}
_ALL = {alias: [c.split(":")[0].strip() for c in columns.split(",")] for alias, (columns, _) in _GROUPS.items()}


@query("user_features", UID + ", ".join(c for c, _ in _GROUPS.values()) + ", " + DEMO, uses="sessions users tracks",
       ctes=", ".join(f"{a} as ({text})" for a, (_, text) in _GROUPS.items()) + f", de as ({DEMOGRAPHICS.format(src='st', k='x')})",
       sql="select st.user_id, " + ", ".join(f"coalesce({a}.{c}, 0) as {c}" for a, names in _ALL.items() for c in names)
       + ", de.tier, de.country, de.age_group, de.tier_encoded, de.age_group_encoded, de.country_frequency from st "
       + " ".join(f"left join {a} on {a}.user_id = st.user_id" for a in ("ge", "pl", "li", "te", "au", "en", "de")))
def user_features(m):
    """The wide frame: every feature group joined on the user."""
    return fe.user_features(m.sessions, m.users, m.tracks)


def skip_sql(history: str) -> str:
    one_hot = ", ".join([f"case when context = '{c}' then 1 else 0 end as context_{c}" for c in sk.CONTEXTS]
                        + [f"case when device = '{d}' then 1 else 0 end as device_{d}" for d in sk.DEVICES])
    return "select session_id, s.user_id, s.track_id, " + ", ".join(f"coalesce(t.{a}, 0) as {a}" for a in AUDIO) + f""",
 extract(hour from timestamp) as hour, case when extract(isodow from timestamp) >= 6 then 1 else 0 end as is_weekend,
 case when extract(hour from timestamp) between 6 and 11 then 1 else 0 end as is_morning,
 case when extract(hour from timestamp) >= 18 then 1 else 0 end as is_evening, {history}, {one_hot}, cast(skipped as int) as skipped
from sessions s left join tracks t on s.track_id = t.track_id"""


ALL_PLAYS = f"""avg({SKIPD}) over (partition by s.user_id) as user_historical_skip_rate,
 count(session_id) over (partition by s.user_id) as user_listen_count, avg({SKIPD}) over (partition by s.track_id) as track_skip_rate"""
_BEFORE = "order by timestamp range between unbounded preceding and interval 1 microsecond preceding"
EARLIER = f"""coalesce(avg({SKIPD}) over (partition by s.user_id {_BEFORE}), 0) as user_historical_skip_rate,
 count(session_id) over (partition by s.user_id {_BEFORE}) as user_listen_count,
 coalesce(avg({SKIPD}) over (partition by s.track_id {_BEFORE}), 0) as track_skip_rate"""
SKIP_COLUMNS = "session_id:i, user_id:i, track_id:i, " + ", ".join(f"{c}:d" for c in sk.SKIP_FEATURES) + ", skipped:i"


@query("skip_model_features", SKIP_COLUMNS, uses="sessions tracks", sql=skip_sql(ALL_PLAYS))
def skip_model_features(m):
    return sk.skip_features(m.sessions, m.tracks)


@query("skip_model_features_point_in_time", SKIP_COLUMNS, uses="sessions tracks", sql=skip_sql(EARLIER))
def skip_model_features_point_in_time(m):
    return sk.skip_features(m.stored_plays(*sk.PLAY_COLUMNS), m.tracks, point_in_time=True)


@query("forecast_features",
       UID + "avg_duration:d, std_duration:d, min_duration:i, max_duration:i, session_count:i, skip_rate:d, avg_hour:d, weekend_ratio:d",
       sql=f"""
select user_id, avg(listen_duration_ms) as avg_duration, stddev_samp(listen_duration_ms) as std_duration,
 min(listen_duration_ms) as min_duration, max(listen_duration_ms) as max_duration, count(*) as session_count,
 avg({SKIPD}) as skip_rate, avg(extract(hour from timestamp)) as avg_hour,
 avg(case when extract(isodow from timestamp) >= 6 then 1e0 else 0e0 end) as weekend_ratio from sessions group by 1""")
def forecast_features(m):
    return fe.forecast_features(m.sessions)


@query("duration_features", UID + "session_count:i, duration_std:d, skip_rate:d, avg_hour:d, avg_duration:d", sql=f"""
select user_id, count(*) as session_count, coalesce(stddev_samp(listen_duration_ms), 0) as duration_std, avg({SKIPD}) as skip_rate,
 avg(extract(hour from timestamp)) as avg_hour, avg(listen_duration_ms) as avg_duration from sessions group by 1""")
def duration_features(m):
    return fe.duration_features(m.sessions)


@query("experiment_user_metrics", UID + "total_sessions:i, skip_rate:d, total_listen_time:i", sql=f"""
select user_id, count(*) as total_sessions, avg({SKIPD}) as skip_rate, sum(listen_duration_ms) as total_listen_time
from sessions group by 1""")
def experiment_user_metrics(m):
    return fe.experiment_metrics(m.sessions)


GAPS = """
gaps as (select user_id, ts, value, event_type, case when ts - lag(ts) over w <= interval '30' minute then 0 else 1 end as starts
 from events window w as (partition by user_id order by ts)),
labelled as (select *, sum(starts) over (partition by user_id order by ts, starts desc rows unbounded preceding) as session_no from gaps)"""


@query("sessionized_events", "user_id:i, session_no:i, session_start:ts, session_end:ts, events:i", uses="", ctes=GAPS, sql="""
select user_id, session_no, min(ts) as session_start, max(ts) as session_end, count(*) as events from labelled group by 1, 2""")
def sessionized_events(m):
    return sz.sessionize(m.events, ts="ts", minutes=30)


@query("session_labels", "event_id:i, user_id:i, ts:ts, session_no:i", uses="", ctes=GAPS.replace("event_type,", "event_type, event_id,"),
       sql="select event_id, user_id, ts, session_no from labelled")
def session_labels(m):
    return sz.label_sessions(m.events, ts="ts", minutes=30).select("event_id", "user_id", "ts", "session_no")
