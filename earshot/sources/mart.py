"""The listening star schema derived from the order tables used for testing.

The statements run unchanged on Spark and on any engine with the same tables,
so the expected results can be computed independently. ``{name}`` marks an
input table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from earshot.plans.stored import stored

#: Columns of the raw tables used here. Stating them saves a job per read.
RAW_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

USERS_SQL = """
select c_custkey as user_id,
 cast(date '1995-01-01' + cast((c_custkey * 37) % 1825 as int) as timestamp) as signup_date,
 case c_mktsegment when 'AUTOMOBILE' then 'free' when 'BUILDING' then 'premium' when 'FURNITURE' then 'family' when 'HOUSEHOLD' then 'student' else 'trial' end as tier,
 n_name as country,
 case c_custkey % 6 when 0 then '18-24' when 1 then '25-34' when 2 then '35-44' when 3 then '45-54' when 4 then '55+' end as age_group
from {customer} join {nation} on c_nationkey = n_nationkey
"""

TRACKS_SQL = """
select p_partkey as track_id,
 cast(60 + (p_partkey * 7) % 141 as double) as tempo,
 case when p_partkey % 50 = 0 then null else (p_size - 1) / 49.0e0 end as energy,
 ((p_partkey * 13) % 101) / 100.0e0 as danceability, ((p_partkey * 17) % 101) / 100.0e0 as valence,
 ((p_partkey * 29) % 101) / 100.0e0 as acousticness, ((p_partkey * 31) % 101) / 100.0e0 as instrumentalness,
 ((p_partkey * 37) % 101) / 100.0e0 as liveness, ((p_partkey * 41) % 101) / 100.0e0 as speechiness,
 cast(-20 + (p_partkey * 3) % 21 as double) as loudness,
 120000 + p_size * 7000 as duration_ms,
 case when p_partkey % 40 = 0 then null else p_type end as genre, p_brand as artist_id
from {part}
"""

SESSIONS_SQL = """
select l_orderkey as session_id, o_custkey as user_id, l_partkey as track_id,
 cast(l_shipdate as timestamp) + interval '1' minute * cast((l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 1440 as int) as timestamp,
 cast(l_quantity * 4800 as bigint) as listen_duration_ms,
 cast(120000 + p_size * 7000 as bigint) as track_duration_ms,
 l_returnflag = 'R' as skipped,
 case when l_returnflag = 'R' then cast(l_quantity * 4800 as bigint) end as skip_time_ms,
 case o_orderpriority when '1-URGENT' then 'playlist' when '2-HIGH' then 'album' when '3-MEDIUM' then 'radio' when '4-NOT SPECIFIED' then 'search' else 'recommendation' end as context,
 case l_suppkey % 4 when 0 then 'mobile' when 1 then 'desktop' when 2 then 'tablet' else 'smart_speaker' end as device
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
"""

ASSIGNMENTS_SQL = """
select c_custkey as user_id, 'recs' as test_name,
 case when md5(concat('42:', cast(c_custkey as varchar(20)))) < '8' then 'control' else 'treatment' end as variant,
 timestamp '1995-01-31 00:00:00' as assignment_date from {customer}
"""

RESULTS_SQL = """
select user_id, 'recs' as test_name, 'skip_rate' as metric_name,
 avg(case when skipped then 1e0 else 0e0 end) as metric_value
from {sessions} group by user_id
"""


@dataclass
class Mart:
    """Lazy access to the derived tables of one data directory."""

    spark: SparkSession
    directory: str
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.directory}/{name}.parquet")

    def _get(self, name: str, text: str, *raw: str, **derived: DataFrame) -> DataFrame:
        if name not in self._cache:
            inputs = {**{r: self.raw(r) for r in raw}, **derived}
            self._cache[name] = self.spark.sql(text, **inputs)
        return self._cache[name]

    @property
    def users(self) -> DataFrame:
        return self._get("users", USERS_SQL, "customer", "nation")

    @property
    def tracks(self) -> DataFrame:
        return self._get("tracks", TRACKS_SQL, "part")

    @property
    def sessions(self) -> DataFrame:
        return self._get("sessions", SESSIONS_SQL, "lineitem", "orders", "part")

    @property
    def stored_sessions(self) -> DataFrame:
        """The plays, written once: a job that reads them several times would repeat both their joins each time."""
        if "stored_sessions" not in self._cache:
            self._cache["stored_sessions"] = stored(self.sessions, "plays")
        return self._cache["stored_sessions"]

    def stored_plays(self, *columns: str | Column) -> DataFrame:
        """Only these columns of the plays, written once: the others go neither through the joins' shuffles nor to the files."""
        return stored(self.sessions.select(*columns), "plays")

    @property
    def assignments(self) -> DataFrame:
        return self._get("assignments", ASSIGNMENTS_SQL, "customer")

    @property
    def results(self) -> DataFrame:
        return self._get("results", RESULTS_SQL, sessions=self.sessions)

    @property
    def events(self) -> DataFrame:
        """The event log, its zone-less time made an instant (UTC session)."""
        raw = self.raw("events")
        return raw.withColumn("ts", raw["ts"].cast("timestamp"))
