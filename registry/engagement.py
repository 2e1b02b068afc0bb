"""Reports over plays: activity, skip rates, content and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import engagement as eng
from earshot.operators import sketches
from earshot.plans.stored import stored
from registry.base import SKIP01, SKIPD, pct, query


@query("dau_mau_events", "date:date, dau:i, mau:i, stickiness_ratio:d", uses="", sql=f"""
select d.date, d.dau, m.mau, {pct('d.dau * 1e2 / m.mau')} as stickiness_ratio
from (select cast(ts as date) as date, count(distinct user_id) as dau from events group by 1) d
join (select date_trunc('month', ts) as month, count(distinct user_id) as mau from events group by 1) m
  on date_trunc('month', d.date) = m.month""")
def dau_mau_events(m):
    return eng.stickiness(m.events, ts="ts")


@query("dau_mau_stickiness", "date:date, dau:i, mau:i, stickiness_ratio:d", sql=f"""
select d.date, d.dau, m.mau, {pct('d.dau * 1e2 / m.mau')} as stickiness_ratio
from (select cast(timestamp as date) as date, count(distinct user_id) as dau from sessions group by 1) d
join (select date_trunc('month', timestamp) as month, count(distinct user_id) as mau from sessions group by 1) m
  on date_trunc('month', d.date) = m.month""")
def dau_mau_stickiness(m):
    return eng.stickiness(m.sessions)


@query("dashboard_dau_mau", "date:date, dau:i, month, mau:i, dau_mau_ratio:d", sql="""
select d.date, d.dau, m.month, m.mau, d.dau * 1e0 / m.mau as dau_mau_ratio
from (select cast(timestamp as date) as date, count(distinct user_id) as dau from sessions group by 1) d
join (select strftime(timestamp, '%Y-%m') as month, count(distinct user_id) as mau from sessions group by 1) m
  on strftime(d.date, '%Y-%m') = m.month""")
def dashboard_dau_mau(m):
    return eng.dau_mau(m.sessions)


@query("dau_mau_percent", "date:date, dau:i, month, mau:i, stickiness:d", sql="""
select d.date, d.dau, m.month, m.mau, d.dau * 1e2 / m.mau as stickiness
from (select cast(timestamp as date) as date, count(distinct user_id) as dau from sessions group by 1) d
join (select strftime(timestamp, '%Y-%m') as month, count(distinct user_id) as mau from sessions group by 1) m
  on strftime(d.date, '%Y-%m') = m.month""")
def dau_mau_percent(m):
    return eng.stickiness_percent(m.sessions)


@query("engagement_segments", "user_segment, user_count:i, avg_listen_hours:d, avg_skip_rate:d", sql=f"""
select case when n >= 100 then 'Power User' when n >= 30 then 'Active' when n >= 10 then 'Casual' else 'Light' end as user_segment,
 count(*) as user_count, {pct('avg(hours)')} as avg_listen_hours, {pct('avg(skip_rate) * 100')} as avg_skip_rate
from (select user_id, count(*) as n, sum(listen_duration_ms) / 3600000.0e0 as hours, avg({SKIP01}) as skip_rate
      from sessions group by user_id) u group by 1""")
def engagement_segments(m):
    return eng.engagement_segments(m.sessions)


@query("segment_summary", "segment, users:i, avg_sessions:d, avg_hours:d", sql="""
select case when n >= 60 then 'Power User' when n >= 45 then 'Active' when n >= 20 then 'Casual' else 'Light' end as segment,
 count(*) as users, avg(n) as avg_sessions, avg(hours) as avg_hours
from (select user_id, count(*) as n, sum(listen_duration_ms) / 3600000.0e0 as hours from sessions group by user_id) u
group by 1""")
def segment_summary(m):
    return eng.segment_summary(m.sessions, {"Power User": 60, "Active": 45, "Casual": 20})


@query("skip_rate_by_genre", "genre, total_plays:i, skips:i, skip_rate:d, avg_listen_seconds:d",
       uses="sessions tracks", sql=f"""
select t.genre, count(*) as total_plays, sum({SKIP01}) as skips, {pct(f'avg({SKIP01}) * 100')} as skip_rate,
 {pct('avg(s.listen_duration_ms) / 1000')} as avg_listen_seconds
from sessions s join tracks t on s.track_id = t.track_id group by t.genre""")
def skip_rate_by_genre(m):
    return eng.skip_report_by_genre(m.sessions, m.tracks)


@query("skip_rate_by_hour", "hour:i, sessions:i, skip_rate:d", sql=f"""
select extract(hour from timestamp) as hour, count(*) as sessions, {pct(f'avg({SKIP01}) * 100')} as skip_rate
from sessions group by 1""")
def skip_rate_by_hour(m):
    return eng.skip_report_by_hour(m.sessions)


@query("skip_rate_by_energy", "energy_level, plays:i, skip_rate:d", uses="sessions tracks", sql=f"""
select case when t.energy < 0.3 then 'Low Energy' when t.energy < 0.7 then 'Medium Energy' else 'High Energy' end as energy_level,
 count(*) as plays, {pct(f'avg({SKIP01}) * 100')} as skip_rate
from sessions s join tracks t on s.track_id = t.track_id group by 1""")
def skip_rate_by_energy(m):
    return eng.skip_report_by_energy(m.sessions, m.tracks)


@query("dashboard_skip_by_genre", "genre, skip_rate:d", uses="sessions tracks", sql=f"""
select genre, avg({SKIPD}) as skip_rate from sessions s left join tracks t on s.track_id = t.track_id
where genre is not null group by genre""")
def dashboard_skip_by_genre(m):
    return eng.skip_rates(m.sessions, m.tracks)["by_genre"]


@query("dashboard_skip_by_hour", "hour:i, skip_rate:d", sql=f"""
select extract(hour from timestamp) as hour, avg({SKIPD}) as skip_rate from sessions group by 1""")
def dashboard_skip_by_hour(m):
    return eng.skip_rates(m.sessions, m.tracks)["by_hour"]


@query("dashboard_skip_by_context", "context, skip_rate:d", sql=f"""
select context, avg({SKIPD}) as skip_rate from sessions group by 1""")
def dashboard_skip_by_context(m):
    return eng.skip_rates(m.sessions, m.tracks)["by_context"]


@query("skip_percent_by_genre", "genre, skip_rate:d, plays:i", uses="sessions tracks", sql=f"""
select genre, avg({SKIPD}) * 100 as skip_rate, count(*) as plays
from sessions s left join tracks t on s.track_id = t.track_id group by genre""")
def skip_percent_by_genre(m):
    return eng.skip_percent_by_genre(m.sessions, m.tracks)


@query("skip_percent_by_hour", "hour:i, skip_rate:d", sql=f"""
select extract(hour from timestamp) as hour, avg({SKIPD}) * 100 as skip_rate from sessions group by 1""")
def skip_percent_by_hour(m):
    return eng.skip_percent_by_hour(m.sessions)


@query("skip_percent_by_energy", "energy_level, skip_rate:d", uses="sessions tracks", sql=f"""
select case when energy <= 0.33 then 'Low' when energy <= 0.66 then 'Medium' else 'High' end as energy_level,
 avg({SKIPD}) * 100 as skip_rate
from sessions s left join tracks t on s.track_id = t.track_id where energy > 0 and energy <= 1 group by 1""")
def skip_percent_by_energy(m):
    return eng.skip_percent_by_energy(m.sessions, m.tracks)


@query("top_tracks", "track_id:i, genre, play_count:i, listen_through_rate:d, avg_completion_pct:d",
       uses="sessions tracks", sql=f"""
select t.track_id, t.genre, count(*) as play_count,
 {pct('avg(case when skipped then 0 else 1 end) * 100')} as listen_through_rate,
 {pct('avg(s.listen_duration_ms) / t.duration_ms * 100')} as avg_completion_pct
from sessions s join tracks t on s.track_id = t.track_id
group by t.track_id, t.genre, t.duration_ms having count(*) >= 10
order by listen_through_rate desc, t.track_id limit 100""")
def top_tracks(m):
    return eng.top_tracks(m.sessions, m.tracks)


@query("genre_trends_weekly", "week:date, genre, plays:i, genre_share:d", uses="sessions tracks", sql=f"""
select week, genre, plays, {pct('plays * 1e2 / sum(plays) over (partition by week)')} as genre_share
from (select cast(date_trunc('week', s.timestamp) as date) as week, t.genre, count(*) as plays
      from sessions s join tracks t on s.track_id = t.track_id group by 1, 2) w""")
def genre_trends_weekly(m):
    return eng.genre_trends(m.sessions, m.tracks)


@query("genre_distribution", "genre, n:i, pct:d", uses="sessions tracks", sql="""
select genre, n, n * 1e2 / sum(n) over () as pct
from (select t.genre, count(*) as n from sessions s left join tracks t on s.track_id = t.track_id group by 1) g""")
def genre_distribution(m):
    return eng.genre_distribution(m.sessions, m.tracks)


@query("tier_patterns", "tier, users:i, total_sessions:i, sessions_per_user:d, avg_listen_minutes:d, skip_rate:d",
       uses="sessions users", sql=f"""
select u.tier, count(distinct u.user_id) as users, count(*) as total_sessions,
 {pct('count(*) * 1e0 / count(distinct u.user_id)')} as sessions_per_user,
 {pct('avg(s.listen_duration_ms) / 60000')} as avg_listen_minutes, {pct(f'avg({SKIP01}) * 100')} as skip_rate
from users u join sessions s on u.user_id = s.user_id group by u.tier""")
def tier_patterns(m):
    return eng.tier_patterns(m.users, m.sessions)


@query("device_patterns", "device, sessions:i, pct_sessions:d, avg_listen_minutes:d, skip_rate:d", sql=f"""
select device, count(*) as sessions, {pct('count(*) * 1e2 / sum(count(*)) over ()')} as pct_sessions,
 {pct('avg(listen_duration_ms) / 60000')} as avg_listen_minutes, {pct(f'avg({SKIP01}) * 100')} as skip_rate
from sessions group by device""")
def device_patterns(m):
    return eng.device_patterns(m.sessions)


@query("context_patterns", "context, sessions:i, skip_rate:d, avg_duration_min:d", sql=f"""
select context, count(*) as sessions, {pct(f'avg({SKIP01}) * 100')} as skip_rate,
 {pct('avg(listen_duration_ms) / 60000')} as avg_duration_min
from sessions group by context""")
def context_patterns(m):
    return eng.context_patterns(m.sessions)


@query("listening_heatmap", "weekday, hour:i, sessions:i", sql="""
select dayname(timestamp) as weekday, extract(hour from timestamp) as hour, count(*) as sessions
from sessions group by 1, 2""")
def listening_heatmap(m):
    return eng.listening_heatmap(m.sessions)


@query("view_daily_active_users", "date:date, dau:i, total_sessions:i, avg_listen_duration:d, skip_rate:d", sql=f"""
select cast(timestamp as date) as date, count(distinct user_id) as dau, count(*) as total_sessions,
 avg(listen_duration_ms) as avg_listen_duration, avg({SKIP01}) as skip_rate from sessions group by 1""")
def view_daily_active_users(m):
    return eng.daily_active_users(m.sessions)


@query("view_monthly_active_users", "month:date, mau:i, total_sessions:i", sql="""
select date_trunc('month', timestamp) as month, count(distinct user_id) as mau, count(*) as total_sessions
from sessions group by 1""")
def view_monthly_active_users(m):
    return eng.monthly_active_users(m.sessions)


@query("view_user_cohort_summary", "cohort_month:date, tier, users:i, avg_account_age_days:d", uses="users", sql="""
select date_trunc('month', signup_date) as cohort_month, tier, count(*) as users,
 avg(date_diff('second', signup_date, timestamp '2001-01-01 00:00:00') / 86400.0e0) as avg_account_age_days
from users group by 1, 2""")
def view_user_cohort_summary(m):
    return eng.user_cohort_summary(m.users, F.lit("2001-01-01").cast("timestamp"))


@query("retention_curve_daily", "day:i, users:i, retention_rate:d", uses="sessions users", sql="""
select d.day, coalesce(c.users, 0) as users,
 coalesce(c.users, 0) * 1e0 / (select count(distinct user_id) from users) as retention_rate
from (select unnest(range(31)) as day) d left join (
  select date_diff('day', cast(u.signup_date as date), cast(s.timestamp as date)) as day, count(distinct s.user_id) as users
  from sessions s join users u on s.user_id = u.user_id group by 1) c on c.day = d.day""")
def retention_curve_daily(m):
    return eng.retention_curve(m.users, m.sessions)


_METRICS = ("user_id:i, total_sessions:i, total_listen_time_ms:i, skip_rate:d, avg_session_duration_ms:d, "
            "unique_tracks_played:i, unique_genres:i, last_active_date:date, engagement_score:d")
_METRICS_SQL = f"""
select user_id, count(*) as total_sessions, sum(listen_duration_ms) as total_listen_time_ms,
 avg({SKIP01}) as skip_rate, avg(listen_duration_ms) as avg_session_duration_ms,
 count(distinct track_id) as unique_tracks_played, cast(null as bigint) as unique_genres,
 max(cast(timestamp as date)) as last_active_date, cast(null as double) as engagement_score
from sessions group by user_id"""


@query("user_metrics", _METRICS, sql=_METRICS_SQL)
def user_metrics(m):
    return eng.user_metrics(m.sessions)


@query("user_metrics_upsert", _METRICS, sql=_METRICS_SQL)
def user_metrics_upsert(m):
    """A table as of mid 1997 brought up to date for the users who played since."""
    cut = F.lit("1997-07-01").cast("timestamp")
    current = eng.user_metrics(m.sessions.where(F.col("timestamp") < cut))
    return eng.upsert_user_metrics(current, m.sessions, m.sessions.where(F.col("timestamp") >= cut))


@query("user_metrics_stamped", _METRICS + ", updated_at:ts", sql=f"""
select *, case when user_id % 3 = 0 then timestamp '2001-02-03 04:05:06' else timestamp '2000-01-01 00:00:00' end as updated_at
from ({_METRICS_SQL}) x""")
def user_metrics_stamped(m):
    """The table with the time of each row's last update: all users at first, a third of them once more."""
    first = eng.user_metrics(m.sessions, F.lit("2000-01-01 00:00:00"))
    return eng.upsert_user_metrics(first, m.sessions, m.users.where("user_id % 3 = 0"), F.lit("2001-02-03 04:05:06"))


_NEAR = "grain, date:date, near:b"
_NEAR_SQL = """
select 'day' as grain, cast(ts as date) as date, true as near from events {closed_days} group by 2
union all select 'month', cast(date_trunc('month', ts) as date), true from events {closed_days} group by 2
union all select 'rolling', cast(ts as date), true from events {closed_days} group by 2"""


def near_the_exact_number(events, daily):
    """Sketched users per day, month and 28 days, and whether each is within 5 % of the exact number."""
    seen = events.where("user_id is not null").select(F.to_date("ts").alias("date"), "user_id").distinct()
    count = F.countDistinct("user_id").alias("exact")
    spread = seen.select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(27)), lambda d: F.date_add("date", d))).alias("date"))
    pairs = {"day": (sketches.days(daily), seen.groupBy("date").agg(count)),
             "month": (sketches.months(daily).withColumnRenamed("month", "date"), seen.groupBy(F.trunc("date", "month").alias("date")).agg(count)),
             "rolling": (sketches.rolling(daily), spread.groupBy("date").agg(count))}
    out = [guess.join(exact, "date").select(F.lit(grain).alias("grain"), "date", (F.abs(F.col("users") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))
           for grain, (guess, exact) in pairs.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("sketched_active_users", _NEAR, uses="", sql=_NEAR_SQL.format(closed_days=""))
def sketched_active_users(m):
    """Days, months and rolling four weeks from one stored sketch a day."""
    return near_the_exact_number(m.events, stored(sketches.daily_sketches(m.events), "sketches"))
