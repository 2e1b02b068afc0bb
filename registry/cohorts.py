"""Cohort retention, engagement and churn."""

from __future__ import annotations

from earshot.operators import cohorts as co
from registry.base import SKIPD, pct, query

BOTH = "sessions users"


def retention_sql(unit: str, number: str, limit: int | None) -> str:
    """Retention in long form: ``number`` is the period distance of a and c."""
    cut = f"and {number} < {limit}" if limit else ""
    return f"""
select a.cohort, a.activity_period, a.period_number, a.active_users, z.cohort_size,
 a.active_users * 1e2 / z.cohort_size as retention_rate
from (select c as cohort, a as activity_period, {number} as period_number, count(distinct user_id) as active_users
      from (select s.user_id, cast(date_trunc('{unit}', u.signup_date) as date) as c,
              cast(date_trunc('{unit}', s.timestamp) as date) as a
            from sessions s join users u on s.user_id = u.user_id) j
      where a >= c {cut} group by 1, 2, 3) a
join (select cast(date_trunc('{unit}', signup_date) as date) as cohort, count(distinct user_id) as cohort_size
      from users group by 1) z on a.cohort = z.cohort"""


MONTHS = "date_diff('month', c, a)"
MONTHLY = retention_sql("month", MONTHS, 12)
LONG = "cohort:date, activity_period:date, period_number:i, active_users:i, cohort_size:i, retention_rate:d"


def at(n: int) -> str:
    return f"max(case when period_number = {n} then retention_rate end)"


@query("cohort_retention_monthly", LONG, uses=BOTH, sql=MONTHLY)
def cohort_retention_monthly(m):
    return co.retention(m.users, m.sessions, "monthly", 12)


@query("cohort_retention_weekly", LONG, uses=BOTH,
       sql=retention_sql("week", "date_diff('day', c, a) // 7", 12))
def cohort_retention_weekly(m):
    return co.retention(m.users, m.sessions, "weekly", 12)


@query("cohort_retention_quarterly", LONG, uses=BOTH,
       sql=retention_sql("quarter", "date_diff('month', c, a) // 3", 12))
def cohort_retention_quarterly(m):
    return co.retention(m.users, m.sessions, "quarterly", 12)


@query("cohort_retention_report",
       "cohort_month:date, cohort_size:i, activity_month:date, months_since_signup:i, users:i, retention_rate:d",
       uses=BOTH, ctes=f"r as ({retention_sql('month', MONTHS, None)})", sql=f"""
select cohort as cohort_month, cohort_size, activity_period as activity_month,
 period_number as months_since_signup, active_users as users, {pct('active_users * 1e2 / cohort_size')} as retention_rate
from r""")
def cohort_retention_report(m):
    return co.monthly_retention_report(m.users, m.sessions)


@query("cohort_retention_matrix", "cohort:date, " + ", ".join(f"period_{n}:d" for n in range(12)), uses=BOTH,
       ctes=f"r as ({MONTHLY})",
       sql="select cohort, " + ", ".join(f"{at(n)} as period_{n}" for n in range(12)) + " from r group by cohort")
def cohort_retention_matrix(m):
    return co.retention_matrix(co.retention(m.users, m.sessions), 12)


@query("cohort_stats", "cohort:date, cohort_size:i, initial_retention:d, period_1_retention:d, period_3_retention:d",
       uses=BOTH, ctes=f"r as ({MONTHLY})", sql=f"""
select z.cohort, z.cohort_size, {at(0)} as initial_retention, {at(1)} as period_1_retention, {at(3)} as period_3_retention
from (select cast(date_trunc('month', signup_date) as date) as cohort, count(distinct user_id) as cohort_size from users group by 1) z
left join r on r.cohort = z.cohort group by z.cohort, z.cohort_size""")
def cohort_stats(m):
    return co.cohort_stats(m.users, co.retention(m.users, m.sessions))


@query("retention_summary",
       "avg_initial_retention:d, avg_period_1_retention:d, avg_period_3_retention:d, avg_period_6_retention:d, "
       "best_cohort, worst_cohort, num_cohorts:i", uses=BOTH,
       ctes=f"r as ({MONTHLY}), w as (select cohort, {at(0)} as p0, {at(1)} as p1, {at(3)} as p3, {at(6)} as p6 from r group by cohort)",
       sql="""
select avg(p0) as avg_initial_retention, avg(p1) as avg_period_1_retention, avg(p3) as avg_period_3_retention,
 avg(p6) as avg_period_6_retention,
 (select strftime(cohort, '%Y-%m') from w where p1 is not null order by p1 desc, cohort limit 1) as best_cohort,
 (select strftime(cohort, '%Y-%m') from w where p1 is not null order by p1, cohort limit 1) as worst_cohort,
 count(*) as num_cohorts from w""")
def retention_summary(m):
    return co.retention_summary(co.retention(m.users, m.sessions))


@query("average_retention_curve", "period_number:i, avg_retention:d, se:d, ci_lower:d, ci_upper:d", uses=BOTH,
       ctes=f"r as ({MONTHLY})", sql="""
select period_number, a as avg_retention, se, a - 1.96e0 * se as ci_lower, a + 1.96e0 * se as ci_upper
from (select period_number, avg(retention_rate) as a, stddev_samp(retention_rate) / sqrt(count(*)) as se
      from r group by 1) x""")
def average_retention_curve(m):
    return co.average_retention(co.retention(m.users, m.sessions))


@query("cohort_assignment", "user_id:i, cohort:date", uses="users",
       sql="select user_id, date_trunc('month', signup_date) as cohort from users")
def cohort_assignment(m):
    return co.assign_cohorts(m.users).select("user_id", "cohort")


@query("cohort_engagement",
       "cohort, unique_users:i, total_sessions:i, total_listen_time_ms:i, avg_listen_duration_ms:d, skip_rate:d, "
       "sessions_per_user:d, listen_hours_per_user:d", uses=BOTH, sql=f"""
select strftime(u.signup_date, '%Y-%m') as cohort, count(distinct s.user_id) as unique_users,
 count(session_id) as total_sessions, sum(listen_duration_ms) as total_listen_time_ms,
 avg(listen_duration_ms) as avg_listen_duration_ms, avg({SKIPD}) as skip_rate,
 count(session_id) * 1e0 / count(distinct s.user_id) as sessions_per_user,
 sum(listen_duration_ms) * 1e0 / count(distinct s.user_id) / 3600000 as listen_hours_per_user
from sessions s join users u on s.user_id = u.user_id group by 1""")
def cohort_engagement(m):
    return co.cohort_engagement(m.users, m.sessions)


@query("cohort_engagement_hours",
       "cohort:date, unique_users:i, total_sessions:i, total_listen_time_hrs:d, avg_listen_duration_min:d, "
       "skip_rate:d, sessions_per_user:d", uses=BOTH, sql=f"""
select date_trunc('month', u.signup_date) as cohort, count(distinct s.user_id) as unique_users, count(*) as total_sessions,
 sum(listen_duration_ms) / 3600000.0e0 as total_listen_time_hrs, avg(listen_duration_ms) / 60000 as avg_listen_duration_min,
 avg({SKIPD}) * 100 as skip_rate, count(*) * 1e0 / count(distinct s.user_id) as sessions_per_user
from sessions s join users u on s.user_id = u.user_id group by 1""")
def cohort_engagement_hours(m):
    return co.cohort_engagement_hours(m.users, m.sessions)


@query("churn_risk", "user_id:i, last_activity:ts, days_inactive:i, churn_risk:b", uses=BOTH, sql="""
select u.user_id, l.last_activity,
 coalesce(cast(floor(date_diff('second', l.last_activity, n.now) / 86400.0e0) as bigint), 999) as days_inactive,
 l.last_activity is null or floor(date_diff('second', l.last_activity, n.now) / 86400.0e0) >= 30 as churn_risk
from users u left join (select user_id, max(timestamp) as last_activity from sessions group by 1) l on u.user_id = l.user_id
cross join (select max(timestamp) as now from sessions) n""")
def churn_risk(m):
    return co.churn_risk(m.users, m.sessions).select("user_id", "last_activity", "days_inactive", "churn_risk")


CHURNED = """
select u.user_id, l.last_active, date_diff('day', l.last_active, n.today) as days_inactive,
 l.last_active is null or date_diff('day', l.last_active, n.today) >= 30 as is_churned
from users u left join (select user_id, max(cast(timestamp as date)) as last_active from sessions group by 1) l on u.user_id = l.user_id
cross join (select max(cast(timestamp as date)) as today from sessions) n"""


@query("churned_users", "user_id:i, last_active:date, days_inactive:i, is_churned:b", uses=BOTH, sql=CHURNED)
def churned_users(m):
    return co.churned_users(m.users, m.sessions).select("user_id", "last_active", "days_inactive", "is_churned")


@query("churn_rate", "churn_rate:d", uses=BOTH,
       sql=f"select avg(cast(cast(is_churned as int) as double)) * 100 as churn_rate from ({CHURNED}) c")
def churn_rate(m):
    return co.churn_rate(co.churned_users(m.users, m.sessions))


@query("cohort_overview", "total_users:i, total_sessions:i, num_cohorts:i, avg_period_1_retention:d, churn_rate:d",
       uses=BOTH, ctes=f"r as ({MONTHLY}), c as ({CHURNED})", sql="""
select (select count(*) from users) as total_users, (select count(*) from sessions) as total_sessions,
 count(distinct cohort) as num_cohorts,
 avg(case when period_number = 1 then retention_rate end) as avg_period_1_retention,
 (select avg(cast(cast(is_churned as int) as double)) * 100 from c) as churn_rate from r""")
def cohort_overview(m):
    return co.cohort_overview(m.users, m.sessions)
