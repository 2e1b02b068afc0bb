"""Streams over the given tables, run until they have caught up."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import experiments as ex, sequential
from earshot.sources.mart import RAW_SCHEMAS
from earshot.streaming import late, live, sinks
from registry.base import query
from registry.engagement import _NEAR, _NEAR_SQL, near_the_exact_number
from registry.experiments import EFFECTS, effects_sql

LATEST = "(select max(ts) - interval '1' hour from events)"  # where the watermark ends


def _stream(m):
    raw = sinks.stream_table(m.spark, f"{m.directory}/events.parquet", RAW_SCHEMAS["events"])
    return raw.withColumn("ts", raw["ts"].cast("timestamp"))


def _drained(m, name, stream):
    return sinks.drain(stream, sinks.run_folder(m.spark, name))


@query("stream_sessions", "user_id:i, session_start:ts, session_end:ts, events:i", uses="", ctes="""
gaps as (select user_id, ts, case when ts - lag(ts) over w <= interval '30' minute then 0 else 1 end as starts
 from events window w as (partition by user_id order by ts)),
s as (select *, sum(starts) over (partition by user_id order by ts, starts desc rows unbounded preceding) as no from gaps)""", sql=f"""
select user_id, min(ts) as session_start, max(ts) as session_end, count(*) as events from s group by user_id, no
having max(ts) + interval '30' minute <= {LATEST}""")
def stream_sessions(m):
    """Sessions the watermark has closed."""
    return _drained(m, "sessions", live.sessions(_stream(m)))


@query("stream_daily_active_users", "date:date, dau:i, events:i", uses="", sql=f"""
select cast(ts as date) as date, count(distinct user_id) as dau, count(*) as events from events group by 1
having cast(cast(ts as date) as timestamp) + interval '1' day <= {LATEST}""")
def stream_daily_active_users(m):
    return _drained(m, "dau", live.daily_active_users(_stream(m)))


@query("stream_approximate_daily_users", "date:date, near:b", uses="", sql=f"""
select cast(ts as date) as date, true as near from events group by 1
having cast(cast(ts as date) as timestamp) + interval '1' day <= {LATEST}""")
def stream_approximate_daily_users(m):
    """Days the watermark has closed, and whether the sketch is within 5 % of the exact number."""
    sketched = _drained(m, "approx-dau", live.approximate_daily_users(_stream(m)))
    exact = m.events.groupBy(F.to_date("ts").alias("date")).agg(F.countDistinct("user_id").alias("exact"))
    return sketched.join(exact, "date").select("date", (F.abs(F.col("dau") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


@query("stream_rolling_rate", "window_start:ts, window_end:ts, events:i, hits:i, rate:d", uses="", sql=f"""
select w as window_start, w + interval '1' hour as window_end, count(*) as events, count(*) filter (event_type = 'error') as hits,
 count(*) filter (event_type = 'error') * 1e0 / count(*) as rate
from (select time_bucket(interval '15' minute, ts) - k * interval '15' minute as w, event_type from events, (select unnest(range(4)) as k) x) y
group by 1, 2 having w + interval '1' hour <= {LATEST}""")
def stream_rolling_rate(m):
    return _drained(m, "rate", live.rolling_rate(_stream(m), F.col("event_type") == "error"))


_EVENT_TEST = """assignments as (select distinct user_id, 'value' as test_name, case when md5(concat('42:', cast(user_id as varchar))) < '8' then 'control' else 'treatment' end as variant from events),
r as (select user_id, 'value' as test_name, 'value' as metric_name, value as metric_value from events)"""


@query("stream_experiment_effects", EFFECTS, uses="", ctes=_EVENT_TEST, sql=effects_sql("r"))
def stream_experiment_effects(m):
    """A running test on event values, analysed from its moments."""
    assigned = ex.assign(m.events.select("user_id").distinct(), "value")
    results = _stream(m).selectExpr("user_id", "'value' as test_name", "'value' as metric_name", "value as metric_value")
    moments = sinks.drain_complete(live.experiment_moments(results, assigned), sinks.run_folder(m.spark, "moments"))
    return ex.effects_from_moments(moments)


@query("stream_experiment_effects_shifted", EFFECTS, uses="", ctes=_EVENT_TEST.replace("value as metric_value", "value + 1.7e9 as metric_value"),
       sql=effects_sql("r", "1.7e9", 3))
def stream_experiment_effects_shifted(m):
    """The same with values far from zero: the planned mean is taken off first, and means are shown to three digits."""
    assigned = ex.assign(m.events.select("user_id").distinct(), "value")
    results = _stream(m).selectExpr("user_id", "'value' as test_name", "'value' as metric_name", "value + 1.7e9 as metric_value")
    moments = sinks.drain_complete(live.experiment_moments(results, assigned, 1.7e9), sinks.run_folder(m.spark, "moments"))
    return ex.effects_from_moments(moments).withColumns({c: F.round(c, 3) for c in ("control_mean", "treatment_mean")})


# Two metrics of one test: event values as they are, and with a gain of 40 for the treated, which a look must find.
_LOOKS = """assigned as (select distinct user_id, case when md5(concat('42:', cast(user_id as varchar))) < '8' then 'control' else 'treatment' end as variant from events),
r as (select ts, user_id, unnest(['value', 'raised']) as metric_name, unnest([value, value + case when variant = 'treatment' then 40 else 0 end]) as x, variant
 from events join assigned using (user_id)),
d as (select metric_name, cast(ts as date) as day, {sums} from r group by 1, 2{closed}),
c as (select metric_name, day, row_number() over w as look, {upto} from d window w as (partition by metric_name order by day rows unbounded preceding)),
e as (select *, st / nullif(nt, 0) - sc / nullif(nc, 0) as effect, (qc - sc * sc / nullif(nc, 0)) / nullif(nc - 1, 0) / nc + (qt - st * st / nullif(nt, 0)) / nullif(nt - 1, 0) / nt as error from c),
l as (select *, 0.5e0 * ln(error / (error + 100)) + 100 * effect * effect / (2 * error * (error + 100)) as ratio,
 sqrt(error * (error + 100) / 100 * (2 * ln(20e0) + ln((error + 100) / error))) as half from e),
o as (select *, coalesce(min(least(1, exp(-ratio))) over w, 1) as p, first_value(case when ratio >= ln(20e0) then case when effect > 0 then 'treatment wins'
 else 'control wins' end end ignore nulls) over w as side from l window w as (partition by metric_name order by day rows unbounded preceding))"""
_LOOK_COLUMNS = ("test_name, metric_name, day:date, look:i, control_n:i, treatment_n:i, effect:d, log_ratio:d, p_value:d, ci_lower:d, ci_upper:d, verdict")
_LOOK_SQL = """select 'value' as test_name, metric_name, day, look, nc as control_n, nt as treatment_n, effect, ratio as log_ratio, p as p_value,
 effect - half as ci_lower, effect + half as ci_upper, coalesce(side, 'continue') as verdict from o"""


def _looks_ctes(closed: str = "") -> str:
    arms = (("c", "control"), ("t", "treatment"))
    return _LOOKS.format(
        closed=closed,
        sums=", ".join(f"count(x) filter (variant = '{arm}') * 1e0 as n{a}, coalesce(sum(x) filter (variant = '{arm}'), 0) as s{a}, "
                       f"coalesce(sum(x * x) filter (variant = '{arm}'), 0) as q{a}" for a, arm in arms),
        upto=", ".join(f"sum({k}{a}) over w as {k}{a}" for a, _ in arms for k in "nsq"))


def _event_results(events, assigned):
    gain = F.when(F.col("variant") == "treatment", 40.0).otherwise(0.0)
    pairs = F.array(F.struct(F.lit("value").alias("metric_name"), F.col("value").alias("metric_value")),
                    F.struct(F.lit("raised").alias("metric_name"), (F.col("value") + gain).alias("metric_value")))
    return (events.join(assigned.select("user_id", "variant"), "user_id")
            .select("user_id", "ts", F.lit("value").alias("test_name"), F.inline(pairs)))


@query("ab_sequential_looks", _LOOK_COLUMNS, uses="", ctes=_looks_ctes(), sql=_LOOK_SQL)
def ab_sequential_looks(m):
    """A verdict for every day of a running test, valid at each."""
    assigned = ex.assign(m.events.select("user_id").distinct(), "value")
    return sequential.looks(live.daily_moments(_event_results(m.events, assigned), assigned, pivot=50.0), scale=10.0)


@query("stream_sequential_looks", _LOOK_COLUMNS, uses="",
       ctes=_looks_ctes(f" having cast(cast(ts as date) as timestamp) + interval '1' day <= {LATEST}"), sql=_LOOK_SQL)
def stream_sequential_looks(m):
    """The same from moments that a stream has closed day by day."""
    assigned = ex.assign(m.events.select("user_id").distinct(), "value")
    daily = live.daily_moments(_event_results(_stream(m), assigned), assigned, pivot=50.0)
    return sequential.looks(_drained(m, "looks", daily), scale=10.0)


# Four deliveries of the events: a tenth arrives late, in the last one; the others by their time in turn.
_DELIVERY = "case when event_id % 10 = 3 then 3 else least(cast(day(ts) - 1 as int) // 10, 2) end"
_DELIVERED = f"""e as (select event_id, user_id, ts, {_DELIVERY} as part from events),
h as (select p as part, (select max(ts) - interval '1' hour from e where part < p) as horizon from (select unnest(range(4)) as p) x),
a as (select e.*, coalesce(ts < horizon, false) as is_late from e join h using (part))"""


def _delivered(m):
    """Feeds the deliveries one after the other; the folder of what was stored."""
    folder = sinks.run_folder(m.spark, "late")
    part = F.when(F.col("event_id") % 10 == 3, 3).otherwise(F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)))
    for k in range(4):
        m.events.where(part == k).write.mode("append").parquet(f"{folder}/inbox")
        late.follow(m.spark.readStream.schema(m.events.schema).parquet(f"{folder}/inbox"), folder)
    return folder


@query("stream_late_events", "event_id:i, user_id:i, ts:ts, batch:i, is_late:b", uses="", ctes=_DELIVERED,
       sql="select event_id, user_id, ts, part as batch, is_late from a")
def stream_late_events(m):
    """All events out of order: those behind the watermark are kept apart, none is lost."""
    return late.rows(m.spark, _delivered(m), m.events.schema).select("event_id", "user_id", "ts", "batch", "is_late")


@query("stream_late_counts", "batch:i, in_time:i, late:i, untimed:i, horizon:ts, latest:ts", uses="", ctes=_DELIVERED, sql="""
select part as batch, count(*) filter (not is_late) as in_time, count(*) filter (is_late) as late, 0 as untimed, any_value(h.horizon) as horizon,
 (select max(ts) from e where e.part <= a.part) as latest from a join h using (part) group by part""")
def stream_late_counts(m):
    """What each batch held, counted while it was written."""
    return late.arrivals(m.spark, _delivered(m))


@query("stream_late_corrections", "date:date, dau_in_time:i, dau:i, late_events:i, events:i", uses="", ctes=_DELIVERED, sql="""
select cast(ts as date) as date, count(distinct user_id) filter (not is_late) as dau_in_time, count(distinct user_id) as dau,
 count(*) filter (is_late) as late_events, count(*) as events from a group by 1""")
def stream_late_corrections(m):
    """Daily users as first reported, and corrected by what came late."""
    return late.corrected_days(m.spark, _delivered(m), m.events.schema)


_CLOSED_DAYS = f"where cast(cast(ts as date) as timestamp) + interval '1' day <= {LATEST}"


@query("stream_sketched_users", _NEAR, uses="", sql=_NEAR_SQL.format(closed_days=_CLOSED_DAYS))
def stream_sketched_users(m):
    """The same from the sketches of the days that a stream has closed."""
    daily = _drained(m, "sketches", live.user_sketches(_stream(m)))
    closed = m.events.join(daily.select("date"), F.to_date("ts") == F.col("date"), "left_semi")
    return near_the_exact_number(closed, daily)


@query("stream_streaks", "user_id:i, first_day:date, last_day:date, length:i", uses="", ctes="""
ad as (select distinct user_id, cast(ts as date) as day from events where user_id is not null),
ru as (select user_id, day, day - cast(row_number() over (partition by user_id order by day) as int) as run from ad)""", sql="""
select user_id, min(day) as first_day, max(day) as last_day, count(*) as length from ru group by user_id, run
having cast(max(day) as timestamp) + interval '25' hour <= (select cast(max(day) as timestamp) - interval '1' hour from ad)""")
def stream_streaks(m):
    """Listening streaks that are over, from a stream; one row of state per open streak."""
    return _drained(m, "streaks", live.streaks(_stream(m)))


@query("stream_user_metrics",
       "user_id:i, total_sessions:i, total_listen_time_ms:d, skip_rate:d, avg_session_duration_ms:d, unique_tracks_played:i, last_active_date:date",
       uses="", sql="""
select user_id, count(*) as total_sessions, sum(value) as total_listen_time_ms,
 avg(case when event_type = 'error' then 1e0 else 0e0 end) as skip_rate, avg(value) as avg_session_duration_ms,
 count(distinct event_type) as unique_tracks_played, max(cast(ts as date)) as last_active_date from events group by 1""")
def stream_user_metrics(m):
    """The metrics table kept by a stream, events taken as plays of their type."""
    plays = _stream(m).selectExpr("user_id", "event_type as track_id", "ts as timestamp", "value as listen_duration_ms",
                                  "event_type = 'error' as skipped")
    table = sinks.UserMetricsTable(m.spark, sinks.run_folder(m.spark, "user-metrics"))
    return table.follow(plays).drop("unique_genres", "engagement_score", "updated_at")
