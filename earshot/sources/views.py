"""Tables and standard views by name, for SQL text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from earshot.operators import engagement as eng


def register_views(tables: dict[str, DataFrame], as_of: datetime | Column | None = None) -> list[str]:
    """Make temp views of the tables, and of what can be derived from them.

    With ``sessions``: daily_active_users and monthly_active_users; with
    ``users`` also user_cohort_summary, ages counted up to ``as_of`` (now by
    default). Returns the names.
    """
    views = dict(tables)
    if "sessions" in tables:
        views["daily_active_users"] = eng.daily_active_users(tables["sessions"])
        views["monthly_active_users"] = eng.monthly_active_users(tables["sessions"])
    if "users" in tables:
        views["user_cohort_summary"] = eng.user_cohort_summary(
            tables["users"], F.current_timestamp() if as_of is None else as_of)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
