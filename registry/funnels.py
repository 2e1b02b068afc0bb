"""Playlist, activation and event funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import funnels as fu
from registry.base import query

DAYS = """days as (select user_id, cast(timestamp as date) as day, count(*) as played,
 sum(case when skipped then 1 else 0 end) as skips, sum(case when skipped then 0 else 1 end) as done
 from sessions where context = 'playlist' group by 1, 2)"""


@query("playlist_day_funnel", "stage, users:i", ctes=DAYS, sql="""
select 'Started Playlist' as stage, count(*) as users from days
union all select 'Played 3+ Tracks', count(*) from days where played >= 3
union all select 'Played 5+ Tracks', count(*) from days where played >= 5
union all select 'Low Skip Rate (<20%)', count(*) from days where skips * 1e0 / played < 0.2""")
def playlist_day_funnel(m):
    return fu.playlist_day_funnel(m.sessions)


LENGTH = 4  # short enough for the ratio stages to be reached
COUNTS = DAYS + f""", c as (select count(*) as n0, count(*) filter (done >= 1) as n1, count(*) filter (done >= 3) as n3,
 count(*) filter (done >= 5) as n5, count(*) filter (done >= 0.5 * {LENGTH}) as h50, count(*) filter (done >= 0.75 * {LENGTH}) as h75,
 count(*) filter (done >= {LENGTH}) as h100 from days)"""


def stages_sql(pairs: list[tuple[str, str]], source: str = "c") -> str:
    first = pairs[0][1]
    parts = []
    for i, (name, column) in enumerate(pairs):
        before = pairs[max(i - 1, 0)][1]
        parts.append(f"select {i} as stage_no, '{name}' as stage, {column} as users, "
                     f"coalesce({column} * 1e0 / nullif({first}, 0), 0) as conversion_rate, "
                     f"coalesce(({before} - {column}) * 1e0 / nullif({before}, 0), 0) as drop_off_rate from {source}")
    return " union all ".join(parts)


STAGE_COLUMNS = "stage_no:i, stage, users:i, conversion_rate:d, drop_off_rate:d"
COMPLETION = list(zip(fu.COMPLETION_STAGES, ("n0", "n1", "n3", "n5", "h50", "h75", "h100")))


def _progress(m):
    return fu.playlist_progress(m.sessions, LENGTH)


@query("playlist_completion_funnel", STAGE_COLUMNS, ctes=COUNTS, sql=stages_sql(COMPLETION))
def playlist_completion_funnel(m):
    return fu.completion_funnel(_progress(m))


@query("playlist_completion_metrics",
       "total_playlist_starts:i, overall_completion_rate:d, track_1_completion:d, track_3_completion:d, "
       "track_5_completion:d, drop_off_track_1_3:d, drop_off_track_3_5:d, biggest_drop_off_stage",
       ctes=COUNTS + f", st as ({stages_sql(COMPLETION)})", sql="""
select n0 as total_playlist_starts, h100 * 1e0 / n0 as overall_completion_rate, n1 * 1e0 / n0 as track_1_completion,
 n3 * 1e0 / n0 as track_3_completion, n5 * 1e0 / n0 as track_5_completion, (n1 - n3) * 1e0 / n1 as drop_off_track_1_3,
 coalesce((n3 - n5) * 1e0 / nullif(n3, 0), 0) as drop_off_track_3_5,
 coalesce((select stage from st where stage_no > 0 and drop_off_rate > 0 order by drop_off_rate desc, stage_no limit 1), 'unknown') as biggest_drop_off_stage
from c""")
def playlist_completion_metrics(m):
    return fu.completion_metrics(_progress(m))


@query("funnel_recommendations", "position:i, recommendation", ctes=COUNTS + f", st as ({stages_sql(COMPLETION)})", sql="""
select row_number() over (order by o) - 1 as position, text as recommendation from (
 select stage_no as o, printf('High drop-off (%.1f%%) at ''%s''. Consider optimizing this stage.', drop_off_rate * 100, stage) as text
 from st where stage_no > 0 and drop_off_rate > 0.2
 union all select 99, printf('Significant drop-off (%.1f%%) between tracks 3-5. Consider improving track recommendations or playlist ordering.', (n3 - n5) * 1e2 / n3)
 from c where (n3 - n5) * 1e0 / nullif(n3, 0) > 0.15) t""")
def funnel_recommendations(m):
    return fu.recommendations(fu.completion_counts(_progress(m)), list(fu.COMPLETION_STAGES))


def activation_ctes(week: str) -> str:
    return f"""p as (select user_id, timestamp, min(timestamp) over (partition by user_id) as first from sessions),
u as (select user_id, min(first) as first, count(*) filter (timestamp <= first + interval '7' day) as n7,
 count(*) filter (timestamp <= first + interval '14' day) as n14, count(distinct {week}) as weeks from p group by 1),
c as (select (select count(*) from users) as n0, (select count(*) from u) as n1,
 (select count(*) from users x join u on x.user_id = u.user_id where floor(date_diff('second', x.signup_date, u.first) / 86400.0e0) <= 1) as n2,
 (select count(*) from u where n7 >= 2) as n3, (select count(*) from u where n14 >= 3) as n4,
 (select count(*) from u where weeks >= 4) as n5)"""


WEEK = "date_trunc('week', timestamp)"
ACTIVATION = list(zip(fu.ACTIVATION_STAGES, ("n0", "n1", "n2", "n3", "n4", "n5")))


@query("activation_funnel", STAGE_COLUMNS, uses="sessions users", ctes=activation_ctes(WEEK), sql=stages_sql(ACTIVATION))
def activation_funnel(m):
    return fu.activation_funnel(m.users, m.sessions)


@query("activation_funnel_week_numbers", STAGE_COLUMNS, uses="sessions users",
       ctes=activation_ctes("extract(week from timestamp)"), sql=stages_sql(ACTIVATION))
def activation_funnel_week_numbers(m):
    return fu.activation_funnel(m.users, m.sessions, iso_week_only=True)


@query("activation_rates",
       "total_signups:i, first_session_rate:d, day_1_activation_rate:d, week_1_retention_rate:d, week_2_retention_rate:d, "
       "weekly_active_rate:d, signup_to_active_conversion:d", uses="sessions users", ctes=activation_ctes(WEEK), sql="""
select n0 as total_signups, n1 * 1e0 / n0 as first_session_rate, n2 * 1e0 / n0 as day_1_activation_rate,
 n3 * 1e0 / n0 as week_1_retention_rate, n4 * 1e0 / n0 as week_2_retention_rate, n5 * 1e0 / n0 as weekly_active_rate,
 n5 * 1e0 / n0 as signup_to_active_conversion from c""")
def activation_rates(m):
    return fu.activation_rates(m.users, m.sessions)


EVENT_STAGES = ["signup", "view", "click", "purchase"]


@query("ordered_event_funnel", STAGE_COLUMNS, uses="", ctes="""
t0 as (select user_id, min(ts) as t from events where event_type = 'signup' group by 1),
t1 as (select e.user_id, min(ts) as t from events e join t0 on e.user_id = t0.user_id where event_type = 'view' and ts >= t group by 1),
t2 as (select e.user_id, min(ts) as t from events e join t1 on e.user_id = t1.user_id where event_type = 'click' and ts >= t group by 1),
t3 as (select e.user_id, min(ts) as t from events e join t2 on e.user_id = t2.user_id where event_type = 'purchase' and ts >= t group by 1),
c as (select (select count(*) from t0) as n0, (select count(*) from t1) as n1, (select count(*) from t2) as n2, (select count(*) from t3) as n3)""",
       sql=stages_sql(list(zip(EVENT_STAGES, ("n0", "n1", "n2", "n3")))))
def ordered_event_funnel(m):
    return fu.event_funnel(m.events, EVENT_STAGES)


@query("playlist_progress_by_list", "user_id:i, day:date, playlist_id:i, tracks_completed:i, playlist_length:i, completion_ratio:d", uses="sessions tracks",
       ctes="""k as (select track_id % 50 as playlist_id, count(*) as n from tracks group by 1),
r as (select user_id, cast(timestamp as date) as day, track_id % 50 as playlist_id, count(*) filter (not coalesce(skipped, false)) as done
 from sessions where context = 'playlist' group by 1, 2, 3)""", sql="""
select user_id, day, r.playlist_id, done as tracks_completed, n as playlist_length, least(done * 1e0 / n, 1) as completion_ratio
from r left join k on r.playlist_id = k.playlist_id""")
def playlist_progress_by_list(m):
    """Each playlist on its own with its own length; here a track belongs to one of fifty lists."""
    plays = m.sessions.withColumn("playlist_id", F.col("track_id") % 50)
    return fu.playlist_progress(plays, playlist_tracks=m.tracks.select((F.col("track_id") % 50).alias("playlist_id"), "track_id"))
