"""Registration of checked queries: a Spark function and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earshot.session import configure
from earshot.sources import mart
from earshot.sources.mart import Mart

#: Most bytes of a shuffle that AQE gives one task. Sorts and hash tables of a task take a multiple of it, and several of
#: them lie in one stage where a query joins and aggregates by user; the default of 64 MB comes to a gigabyte.
TASK_BYTES = "16m"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_RAW = ("region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations").split()
_MART_CTES = {
    "users": mart.USERS_SQL, "tracks": mart.TRACKS_SQL, "sessions": mart.SESSIONS_SQL,
    "assignments": mart.ASSIGNMENTS_SQL, "results": mart.RESULTS_SQL,
}


_FORMS = {
    "double": "cast(round(cast(`{c}` as decimal(38,12)), 6) as double)",
    "float": "cast(round(cast(`{c}` as decimal(38,12)), 6) as double)",
    "tinyint": "cast(`{c}` as bigint)", "smallint": "cast(`{c}` as bigint)", "int": "cast(`{c}` as bigint)",
    "timestamp": "cast(`{c}` as timestamp_ntz)", "boolean": "cast(cast(`{c}` as int) as bigint)",
}


def comparable(df: DataFrame) -> DataFrame:
    """Column types and precision on which two engines can agree."""
    return df.selectExpr(*(_FORMS.get(kind, "`{c}`").format(c=c) + f" as `{c}`" for c, kind in df.dtypes))


_CASTS = {
    "": "{c}", "i": "cast({c} as bigint)", "b": "cast(cast({c} as int) as bigint)",
    "d": "cast(round(cast({c} as decimal(38,12)), 6) as double)",
    "date": "cast({c} as date)", "ts": "cast({c} as timestamp)", "s": "cast({c} as varchar)",
}


def oracle_text(columns: str, body: str, uses: str = "sessions", ctes: str = "") -> str:
    """Complete statement: the mart tables it uses, then ``body``, typed per ``columns``.

    ``columns`` lists ``name`` or ``name:type`` with type i, d, b, date, ts or s.
    """
    raw = {name: name for name in _RAW}
    wanted = uses.split()
    if "results" in wanted and "sessions" not in wanted:
        wanted.insert(0, "sessions")
    parts = [f"{t} as ({_MART_CTES[t].format(sessions='sessions', **raw).strip()})"
             for t in ("users", "tracks", "sessions", "assignments", "results") if t in wanted]
    if ctes:
        parts.append(ctes.strip())
    parts.append(f"answer as ({body.strip()})")
    picked = ", ".join(
        f"{_CASTS[kind].format(c=name)} as {name}"
        for name, _, kind in (item.strip().partition(":") for item in columns.split(",")))
    return f"with {', '.join(parts)} select {picked} from answer"


def query(name: str, columns: str = "", sql: str | None = None, uses: str = "sessions",
          ctes: str = ""):
    """Register ``fn(mart) -> DataFrame`` under ``name``, with its SQL if there is one."""
    def register(fn: Callable[[Mart], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark).conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
            return comparable(fn(Mart(spark, sf_dir.rstrip("/"))))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle_text(columns, sql, uses, ctes)
        return fn
    return register


# SQL fragments shared by many expected results.
SKIP01 = "case when skipped then 1 else 0 end"
SKIPD = "cast(cast(skipped as int) as double)"


def pct(expr: str) -> str:
    """Percent, two digits, rounded as a decimal number."""
    return f"round(cast(({expr}) as decimal(30,12)), 2)"
