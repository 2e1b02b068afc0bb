"""Data quality, sampling, missing values, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot import schemas
from earshot.operators import preparation as pr, quality as qu
from registry.base import query

ALL = "sessions users tracks assignments results"


def _bundle(m):
    return {"users": m.users, "tracks": m.tracks, "sessions": m.sessions,
            "ab_test_assignments": m.assignments, "ab_test_results": m.results}


def _quoted(values):
    return ", ".join(f"'{v}'" for v in values)


_CTE = {"users": "users", "tracks": "tracks", "sessions": "sessions",
        "ab_test_assignments": "assignments", "ab_test_results": "results"}
_COLUMNS = {"users": "user_id signup_date tier", "tracks": "track_id",
            "sessions": "session_id user_id track_id timestamp listen_duration_ms",
            "ab_test_assignments": "user_id test_name variant", "ab_test_results": "user_id test_name metric_name"}


def _checks_sql():
    parts = []
    for table, columns in schemas.DOMAINS.items():
        for column, allowed in columns.items():
            parts.append(f"select 'domain' as rule, '{table}' as table_name, '{column}' as column_name, "
                         f"count(*) filter ({column} not in ({_quoted(allowed)})) as violations from {_CTE[table]}")
    for table, names in _COLUMNS.items():
        for column in names.split():
            parts.append(f"select 'not_null', '{table}', '{column}', count(*) filter ({column} is null) from {_CTE[table]}")
    for table, keys in schemas.KEYS.items():
        if table in _CTE:
            k = ",".join(keys)
            parts.append(f"select 'key', '{table}', '{k}', (select count(*) from (select {k} from {_CTE[table]} group by {k} having count(*) > 1) d)")
    for child, column, parent, pcol in schemas.REFERENCES:
        if child in _CTE and parent in _CTE:
            parts.append(f"select 'reference', '{child}', '{column}', (select count(*) from {_CTE[child]} where {column} is not null "
                         f"and {column} not in (select {pcol} from {_CTE[parent]}))")
    return " union all ".join(parts)


@query("quality_checks", "rule, table_name, column_name, violations:i", uses=ALL, sql=_checks_sql())
def quality_checks(m):
    return qu.check_tables(_bundle(m))


@query("domain_violations", "column_name, violations:i", uses="users",
       sql="select 'tier' as column_name, count(*) filter (tier not in ('free', 'premium', 'family', 'student')) as violations from users")
def domain_violations(m):
    return qu.domain_violations(m.users, "users")


@query("duplicate_keys", "session_id:i, occurrences:i",
       sql="select session_id, count(*) as occurrences from sessions group by 1 having count(*) > 1")
def duplicate_keys(m):
    return qu.key_violations(m.sessions, ["session_id"])


@query("missing_references", "value:i, row_count:i", uses="sessions tracks",
       sql="""select s.track_id as value, count(*) as row_count from sessions s
left join (select track_id from tracks where genre is not null) t on s.track_id = t.track_id
where t.track_id is null group by 1""")
def missing_references(m):
    """Plays whose track is not among the tracks with a genre."""
    return qu.reference_violations(m.sessions, "track_id", m.tracks.where("genre is not null"))


@query("null_counts", "energy:i, genre:i, tempo:i", uses="tracks",
       sql="select count(*) filter (energy is null) as energy, count(*) filter (genre is null) as genre, "
           "count(*) filter (tempo is null) as tempo from tracks")
def null_counts(m):
    return pr.null_counts(m.tracks, ["energy", "genre", "tempo"])


_EVENT_HASH = "md5(concat('7:', cast(event_id as varchar)))"


@query("sample_rows", "event_id:i, user_id:i", uses="",
       sql=f"select event_id, user_id from events order by {_EVENT_HASH} limit 500")
def sample_rows(m):
    return pr.sample(m.events, n=500, seed=7, key=["event_id"]).select("event_id", "user_id")


@query("sample_fraction", "event_id:i, user_id:i", uses="",
       sql=f"select event_id, user_id from events where substr({_EVENT_HASH}, 1, 8) <= '19999999'")
def sample_fraction(m):
    return pr.sample(m.events, frac=0.1, seed=7, key=["event_id"]).select("event_id", "user_id")


_FLAGS_HASH = """md5(concat('42:1:', l_returnflag, ':1:', l_linestatus, ':', length(cast(nth as varchar)), ':', cast(nth as varchar)))"""
_FLAGS = """n as (select l_returnflag, l_linestatus, row_number() over (partition by l_returnflag, l_linestatus) as nth from lineitem)"""


def _flags(m):
    """Rows that repeat thousands of times."""
    return m.raw("lineitem").select("l_returnflag", "l_linestatus")


@query("sample_of_repeated_rows", "l_returnflag, l_linestatus, picked:i", uses="", ctes=_FLAGS, sql=f"""
select l_returnflag, l_linestatus, count(*) as picked from (select * from n order by {_FLAGS_HASH} limit 700) p group by 1, 2""")
def sample_of_repeated_rows(m):
    """Copies of equal rows are numbered and picked one by one."""
    return pr.sample(_flags(m), n=700).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("picked"))


@query("split_of_repeated_rows", "l_returnflag, l_linestatus, is_test:b, row_count:i", uses="", ctes=_FLAGS, sql=f"""
select l_returnflag, l_linestatus, is_test, count(*) as row_count from (select l_returnflag, l_linestatus,
 row_number() over (order by {_FLAGS_HASH}) <= ceil(count(*) over () * 0.2e0) as is_test from n) p group by 1, 2, 3""")
def split_of_repeated_rows(m):
    df = _flags(m)
    return pr.mark_split(df, df.columns).groupBy("l_returnflag", "l_linestatus", "is_test").agg(F.count("*").alias("row_count"))


# Energy with both kinds of gaps: null as it is, NaN for every seventh track.
_GAPS = "g as (select track_id, case when track_id % 7 <> 0 then energy end as energy from tracks)"


def _with_gaps(m):
    return m.tracks.select("track_id", F.when(F.col("track_id") % 7 == 0, float("nan")).otherwise(F.col("energy")).alias("energy"))


@query("missing_counts_with_nan", "energy:i", uses="tracks", ctes=_GAPS, sql="select count(*) filter (energy is null) as energy from g")
def missing_counts_with_nan(m):
    return pr.null_counts(_with_gaps(m), ["energy"])


def _nan_query(strategy, value):
    @query(f"missing_{strategy}_with_nan", "track_id:i, energy:d", uses="tracks", ctes=_GAPS,
           sql=f"select track_id, coalesce(energy, {value}) as energy from g")
    def filled(m):
        return pr.handle_missing(_with_gaps(m), strategy, columns=["energy"])


_nan_query("mean", "(select avg(energy) from g)")
_nan_query("median", "(select median(energy) from g)")
_nan_query("mode", "(select energy from g where energy is not null group by 1 order by count(*) desc, 1 limit 1)")


@query("standardize_with_nan", "track_id:i, energy:d", uses="tracks", ctes=_GAPS, sql="""
select track_id, (energy - avg(energy) over ()) / stddev_pop(energy) over () as energy from g""")
def standardize_with_nan(m):
    """Missing values stay missing."""
    return pr.standardize(_with_gaps(m), ["energy"]).select("track_id", F.when(~F.isnan("energy"), F.col("energy")).alias("energy"))


_TRACK = "track_id:i, energy:d, genre"
_TRACK_COLUMNS = ["track_id", "energy", "genre"]


@query("missing_drop", _TRACK, uses="tracks",
       sql="select track_id, energy, genre from tracks where energy is not null and genre is not null")
def missing_drop(m):
    return pr.handle_missing(m.tracks, "drop", columns=["energy", "genre"]).select(*_TRACK_COLUMNS)


@query("missing_fill", _TRACK, uses="tracks",
       sql="select track_id, energy, coalesce(genre, 'unknown') as genre from tracks")
def missing_fill(m):
    return pr.handle_missing(m.tracks, "fill", "unknown", ["genre"]).select(*_TRACK_COLUMNS)


@query("missing_mean", _TRACK, uses="tracks",
       sql="select track_id, coalesce(energy, (select avg(energy) from tracks)) as energy, genre from tracks")
def missing_mean(m):
    return pr.handle_missing(m.tracks, "mean", columns=["energy", "genre"]).select(*_TRACK_COLUMNS)


@query("missing_median", "session_id:i, track_id:i, skip_time_ms:d",
       sql="select session_id, track_id, coalesce(skip_time_ms, (select median(skip_time_ms) from sessions)) as skip_time_ms from sessions")
def missing_median(m):
    return pr.handle_missing(m.sessions, "median", columns=["skip_time_ms"]).select("session_id", "track_id", "skip_time_ms")


@query("missing_mode", "user_id:i, age_group", uses="users",
       sql="""select user_id, coalesce(age_group, (select age_group from users where age_group is not null
 group by 1 order by count(*) desc, 1 limit 1)) as age_group from users""")
def missing_mode(m):
    return pr.handle_missing(m.users, "mode", columns=["age_group"]).select("user_id", "age_group")


_USER_HASH = "md5(concat('42:', cast(user_id as varchar)))"


@query("train_test_split", "user_id:i, is_test:b", uses="users",
       sql=f"""select user_id, row_number() over (order by {_USER_HASH}) <= ceil((select count(*) from users) * 0.2e0) as is_test from users""")
def train_test_split(m):
    return pr.mark_split(m.users, ["user_id"]).select("user_id", "is_test")


@query("train_test_split_stratified", "user_id:i, tier, is_test:b", uses="users", ctes="""
z as (select tier, size, wanted, floor(size * wanted / total) as base, size * wanted / total - floor(size * wanted / total) as part
 from (select tier, count(*) as size, sum(count(*)) over () * 1e0 as total, ceil(sum(count(*)) over () * 0.2e0) as wanted from users group by 1) a),
q as (select tier, base + case when row_number() over (order by round(part, 9) desc, tier) <= wanted - sum(base) over () then 1 else 0 end as quota from z)""",
       sql=f"""select user_id, u.tier, row_number() over (partition by u.tier order by {_USER_HASH}) <= quota as is_test
from users u join q on u.tier = q.tier""")
def train_test_split_stratified(m):
    return pr.mark_split(m.users, ["user_id"], stratify="tier").select("user_id", "tier", "is_test")


@query("standardize_audio", "track_id:i, tempo:d, danceability:d", uses="tracks", sql="""
select track_id, (tempo - avg(tempo) over ()) / stddev_pop(tempo) over () as tempo,
 (danceability - avg(danceability) over ()) / stddev_pop(danceability) over () as danceability from tracks""")
def standardize_audio(m):
    return pr.standardize(m.tracks, ["tempo", "danceability"]).select("track_id", "tempo", "danceability")


@query("min_max_audio", "track_id:i, tempo:d, loudness:d", uses="tracks", sql="""
select track_id, (tempo - min(tempo) over ()) / (max(tempo) over () - min(tempo) over ()) as tempo,
 (loudness - min(loudness) over ()) / (max(loudness) over () - min(loudness) over ()) as loudness from tracks""")
def min_max_audio(m):
    return pr.min_max(m.tracks, ["tempo", "loudness"]).select("track_id", "tempo", "loudness")


@query("formatted_totals", "user_id:i, listened, plays", sql="""
select user_id, case when s < 60 then printf('%.1fs', s) when s < 3600 then printf('%.1fm', s / 60) else printf('%.1fh', s / 3600) end as listened,
 case when n >= 1000 then printf('%.1fK', n / 1000) else printf('%.1f', n) end as plays
from (select user_id, sum(listen_duration_ms) / 1000.0e0 as s, count(*) * 37e0 as n from sessions group by 1) x""")
def formatted_totals(m):
    """Durations and counts as text (counts enlarged so that K is reached)."""
    from earshot.functions.numbers import format_duration, format_number
    totals = m.sessions.groupBy("user_id").agg(F.sum("listen_duration_ms").alias("ms"), F.count("*").alias("n"))
    return totals.select("user_id", format_duration("ms").alias("listened"),
                         format_number(F.col("n") * 37).alias("plays"))


@query("validated_dates", "o_orderkey:i, day:ts", uses="", sql="""
select o_orderkey, case when o_orderkey % 10 <> 0 then o_orderdate end as day from orders""")
def validated_dates(m):
    """Text dates parsed, those that are none become null in the lenient form."""
    texts = m.raw("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "no date").otherwise(
        F.col("o_orderdate").cast("string")).alias("day"))
    return qu.validate(texts, ["o_orderkey", "day"], ["day"], lenient=True)


@query("validated_dates_strict", "o_orderkey:i, day:ts", uses="", sql="select o_orderkey, o_orderdate as day from orders")
def validated_dates_strict(m):
    return qu.validate(m.raw("orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("day")), ["day"], ["day"])
