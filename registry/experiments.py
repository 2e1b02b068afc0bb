"""A/B test design, assignment and analysis."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from earshot.operators import experiments as ex, features as fe
from registry.base import SKIPD, SKIP01, pct, query

BOTH = "assignments results"
Z = NormalDist().inv_cdf(0.975)
Z_BOTH = Z + NormalDist().inv_cdf(0.8)

EFFECTS = ("test_name, metric_name, control_mean:d, treatment_mean:d, control_std:d, treatment_std:d, control_n:i, treatment_n:i, "
           "absolute_effect:d, relative_effect:d, standard_error:d, t_statistic:d, degrees_of_freedom:d, ci_lower:d, ci_upper:d, effect_size:d")


def effects_sql(results: str, pivot: str = "0e0", digits: int | None = None) -> str:
    """``pivot`` is taken off the values before anything is summed; means are given to so many ``digits``."""
    def rounded(x):
        return x if digits is None else f"round({x}, {digits})"
    value = "metric_value" if pivot == "0e0" else f"(metric_value - {pivot})"
    m1 = "m1" if pivot == "0e0" else f"(m1 + {pivot})"
    return f"""
select test_name, metric_name, {rounded(m1)} as control_mean, {rounded(m1.replace('m1', 'm2'))} as treatment_mean, s1 as control_std, s2 as treatment_std,
 n1 as control_n, n2 as treatment_n, m2 - m1 as absolute_effect, coalesce((m2 - m1) / nullif({m1}, 0), 0) as relative_effect,
 sqrt(s1 * s1 / n1 + s2 * s2 / n2) as standard_error, (m2 - m1) / sqrt(s1 * s1 / n1 + s2 * s2 / n2) as t_statistic,
 pow(s1 * s1 / n1 + s2 * s2 / n2, 2) / (pow(s1 * s1 / n1, 2) / (n1 - 1) + pow(s2 * s2 / n2, 2) / (n2 - 1)) as degrees_of_freedom,
 m2 - m1 - {Z} * sqrt(s1 * s1 / n1 + s2 * s2 / n2) as ci_lower, m2 - m1 + {Z} * sqrt(s1 * s1 / n1 + s2 * s2 / n2) as ci_upper,
 (m2 - m1) / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)) as effect_size
from (select a.test_name, metric_name, avg({value}) filter (variant = 'control') as m1, avg({value}) filter (variant = 'treatment') as m2,
 stddev_samp({value}) filter (variant = 'control') as s1, stddev_samp({value}) filter (variant = 'treatment') as s2,
 count(*) filter (variant = 'control') as n1, count(*) filter (variant = 'treatment') as n2
 from assignments a join {results} r on a.user_id = r.user_id and a.test_name = r.test_name group by 1, 2) g"""


STEPS = 1000


def integral(f: str, upper: str) -> str:
    """Simpson's rule from 0 to ``upper`` for a density written in terms of {x}."""
    weight = f"case when i = 0 or i = {STEPS} then 1 when i % 2 = 1 then 4 else 2 end"
    value = f.format(x=f"({upper} * i / {STEPS}.0e0)")
    return f"(select sum({weight} * {value}) * {upper} / {STEPS * 3}.0e0 from (select unnest(range({STEPS + 1})) as i) g)"


def t_p(t: str, v: str) -> str:
    density = (f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - ({v} + 1) / 2 * ln(1 + {{x}} * {{x}} / {v})) / sqrt({v} * pi())")
    return f"1 - 2 * {integral(density, f'abs({t})')}"


def phi(x: str) -> str:
    return "(0.5e0 + " + integral("exp(-{x} * {x} / 2) / sqrt(2 * pi())", f"({x})") + ")"


SIGNIFICANT = EFFECTS + ", p_value:d, is_significant:b, power:d"


def significance_ctes(results: str) -> str:
    shift = "abs(absolute_effect / standard_error)"
    return f"""e as ({effects_sql(results)}),
sg as (select *, {t_p('e.t_statistic', 'e.degrees_of_freedom')} as p_value, {phi(f'{shift} - {Z}')} + {phi(f'-{shift} - {Z}')} as power from e)"""


@query("ab_summary", "test_name, metric_name, variant, users:i, avg_metric:d, stddev_metric:d", uses=BOTH, sql="""
select a.test_name, metric_name, variant, count(distinct a.user_id) as users, avg(metric_value) as avg_metric, stddev_samp(metric_value) as stddev_metric
from assignments a left join results r on a.user_id = r.user_id and a.test_name = r.test_name group by 1, 2, 3""")
def ab_summary(m):
    return ex.arm_summary(m.assignments, m.results)


@query("ab_comparison", "test_name, metric_name, control_mean:d, treatment_mean:d, absolute_lift:d, relative_lift_pct:d, control_n:i, treatment_n:i",
       uses=BOTH, ctes="""t as (select a.test_name, metric_name, variant, count(distinct a.user_id) as n, avg(metric_value) as mean
 from assignments a join results r on a.user_id = r.user_id and a.test_name = r.test_name group by 1, 2, 3)""", sql=f"""
select c.test_name, c.metric_name, c.mean as control_mean, t.mean as treatment_mean, t.mean - c.mean as absolute_lift,
 {pct('(t.mean - c.mean) / nullif(c.mean, 0) * 100')} as relative_lift_pct, c.n as control_n, t.n as treatment_n
from t c join t on c.test_name = t.test_name and c.metric_name = t.metric_name where c.variant = 'control' and t.variant = 'treatment'""")
def ab_comparison(m):
    return ex.comparison(m.assignments, m.results)


@query("ab_sample_size", "test_name, baseline:d, users_per_arm:i", uses=BOTH, sql=f"""
select test_name, b as baseline, ceil(2 * (b + b * 1.05e0) / 2 * (1 - (b + b * 1.05e0) / 2) * {Z_BOTH ** 2} / pow(b * 1.05e0 - b, 2)) as users_per_arm
from (select test_name, avg(metric_value) as b from results group by 1) x""")
def ab_sample_size(m):
    baseline = m.results.groupBy("test_name").agg(F.avg("metric_value").alias("baseline"))
    return baseline.withColumn("users_per_arm", ex.sample_size(F.col("baseline"), 0.05))


_HASH = "md5(concat('42:', cast(user_id as varchar)))"


@query("ab_assign", "user_id:i, test_name, variant", uses="users",
       sql=f"select user_id, 'home' as test_name, case when {_HASH} < '8' then 'control' else 'treatment' end as variant from users")
def ab_assign(m):
    return ex.assign(m.users, "home")


@query("ab_assign_exact", "user_id:i, test_name, variant", uses="users", sql=f"""
select user_id, 'home' as test_name, case when row_number() over (order by {_HASH}) <= floor((select count(*) from users) * 0.7e0)
 then 'control' else 'treatment' end as variant from users""")
def ab_assign_exact(m):
    return ex.assign(m.users, "home", treatment_ratio=0.3, exact=True)


@query("ab_assign_stratified", "user_id:i, test_name, variant, tier, country", uses="users", ctes="""
z as (select tier, country, count(*) as size, sum(count(*)) over () * 1e0 as total, floor(sum(count(*)) over () * 0.5e0) as wanted from users group by 1, 2),
q as (select tier, country, floor(size * wanted / total) + case when row_number() over (order by round(size * wanted / total - floor(size * wanted / total), 6) desc, tier, country)
 <= wanted - sum(floor(size * wanted / total)) over () then 1 else 0 end as quota from z)""", sql=f"""
select user_id, 'home' as test_name, case when row_number() over (partition by u.tier, u.country order by {_HASH}) <= quota then 'control' else 'treatment' end as variant,
 u.tier, u.country from users u join q on u.tier = q.tier and u.country = q.country""")
def ab_assign_stratified(m):
    return ex.assign(m.users, "home", strata=["tier", "country"])


@query("ab_create_experiment", "user_id:i, test_name, variant", uses="users", sql="""
select user_id, 'paid' as test_name, case when tier = 'free' then 'control' else 'treatment' end as variant from users where tier in ('free', 'premium')""")
def ab_create_experiment(m):
    return ex.create_experiment("paid", m.users.where("tier = 'free'"), m.users.where("tier = 'premium'"))


@query("ab_overlap", "test_name, user_id:i, variants:i", uses="sessions", sql="""
select 'device' as test_name, user_id, count(distinct device) as variants from sessions where device in ('mobile', 'tablet')
group by user_id having count(distinct device) > 1""")
def ab_overlap(m):
    """Users met in both arms when the device decides."""
    rows = m.sessions.where("device in ('mobile', 'tablet')")
    return ex.overlapping_users(rows.selectExpr("user_id", "'device' as test_name", "device as variant"))


@query("ab_balance", "test_name, control_n:i, treatment_n:i, chi_square:d, enough_users:b", uses="assignments", sql="""
select test_name, n1 as control_n, n2 as treatment_n, pow(n2 - (n1 + n2) / 2e0, 2) / ((n1 + n2) / 2e0) * 2 as chi_square,
 least(n1, n2) >= 1000 as enough_users
from (select test_name, count(distinct user_id) filter (variant = 'control') as n1, count(distinct user_id) filter (variant = 'treatment') as n2
 from assignments group by 1) x""")
def ab_balance(m):
    return ex.balance(m.assignments)


@query("ab_ratio_test", "test_name, chi_square:d, p_value:d", uses="assignments", ctes="""
ch as (select test_name, pow(n2 - (n1 + n2) / 2e0, 2) / ((n1 + n2) / 2e0) * 2 as chi_square
 from (select test_name, count(distinct user_id) filter (variant = 'control') as n1, count(distinct user_id) filter (variant = 'treatment') as n2
 from assignments group by 1) x)""", sql=f"select *, 2 * (1 - {phi('sqrt(ch.chi_square)')}) as p_value from ch")
def ab_ratio_test(m):
    """Whether the arms' sizes agree with the planned ratio."""
    return ex.balance_test(m.assignments).select("test_name", "chi_square", "p_value")


@query("ab_effects", EFFECTS, uses=BOTH, sql=effects_sql("results"))
def ab_effects(m):
    return ex.effects(m.assignments, m.results)


def _user_metrics(m):
    wide = fe.experiment_metrics(m.sessions).withColumn("test_name", F.lit("recs"))
    return ex.to_long(wide, ["total_sessions", "skip_rate", "total_listen_time"])


_LONG = f"""l as (select user_id, 'recs' as test_name, unnest(['total_sessions', 'skip_rate', 'total_listen_time']) as metric_name,
 unnest([count(*) * 1e0, avg({SKIPD}), sum(listen_duration_ms) * 1e0]) as metric_value from sessions group by user_id)"""


@query("ab_effects_all_metrics", EFFECTS, uses="sessions assignments", ctes=_LONG, sql=effects_sql("l"))
def ab_effects_all_metrics(m):
    return ex.effects(m.assignments, _user_metrics(m))


@query("ab_arm_intervals", "test_name, metric_name, group, mean:d, se:d, lower:d, upper:d".replace("group", '"group"'), uses=BOTH, sql="""
select test_name, metric_name, g as "group", a as mean, se, a - 1.96e0 * se as lower, a + 1.96e0 * se as upper
from (select a.test_name, metric_name, case variant when 'control' then 'Control' else 'Treatment' end as g, avg(metric_value) as a,
 stddev_samp(metric_value) / sqrt(count(*)) as se from assignments a join results r on a.user_id = r.user_id and a.test_name = r.test_name group by 1, 2, 3) x""")
def ab_arm_intervals(m):
    return ex.arm_intervals(ex.effects(m.assignments, m.results))


@query("ab_significance", SIGNIFICANT, uses="sessions assignments", ctes=_LONG + ", " + significance_ctes("l"),
       sql="select *, p_value < 0.05 as is_significant from sg")
def ab_significance(m):
    """Effects with Welch's p value; the expected ones integrate the density."""
    return ex.analyze(m.assignments, _user_metrics(m))


_RULE = "=" * 60


@query("ab_report", "test_name, metric_name, report", uses=BOTH, ctes=significance_ctes("results"), sql=f"""
select test_name, metric_name, concat(chr(10), '{_RULE}', chr(10), 'A/B TEST: ', test_name, chr(10), '{_RULE}', chr(10),
 format('Control: {{:,d}} users, Mean: {{:.4f}}', control_n, control_mean), chr(10),
 format('Treatment: {{:,d}} users, Mean: {{:.4f}}', treatment_n, treatment_mean), chr(10), chr(10),
 format('Effect: {{:+.4f}} ({{:+.2f}}%)', absolute_effect, relative_effect * 100), chr(10),
 format('95% CI: [{{:.4f}}, {{:.4f}}]', ci_lower, ci_upper), chr(10), format('P-value: {{:.4f}}', p_value), chr(10),
 'Significant: ', case when p_value < 0.05 then 'YES' else 'NO' end, chr(10), '{_RULE}', chr(10)) as report from sg""")
def ab_report(m):
    return ex.report(ex.analyze(m.assignments, m.results))


@query("ab_many_tests", "test_name, metric_name, p_value:d, rank:i, adjusted_p:d, is_discovery:b", uses="sessions assignments",
       ctes=_LONG + ", " + significance_ctes("l") + """,
rk as (select *, row_number() over (order by p_value) as rank, count(*) over () as n from sg)""", sql="""
select test_name, metric_name, p_value, rank, adjusted_p, adjusted_p <= 0.05 as is_discovery
from (select *, least(1, min(p_value * n / rank) over (order by rank desc rows unbounded preceding)) as adjusted_p from rk) x""")
def ab_many_tests(m):
    return ex.adjust_for_many(ex.analyze(m.assignments, _user_metrics(m))).select(
        "test_name", "metric_name", "p_value", "rank", "adjusted_p", "is_discovery")


CHI_COLUMNS = "test_name, control_yes:i, control_no:i, treatment_yes:i, treatment_no:i, chi_square:d"
CHI_SQL = f"""
select test_name, a as control_yes, b as control_no, c as treatment_yes, d as treatment_no,
 (a + b + c + d) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)) as chi_square
from (select test_name, count(*) filter (variant = 'control' and hit) * 1e0 as a, count(*) filter (variant = 'control' and not hit) * 1e0 as b,
 count(*) filter (variant = 'treatment' and hit) * 1e0 as c, count(*) filter (variant = 'treatment' and not hit) * 1e0 as d
 from (select test_name, variant, coalesce(h.hit, false) as hit from assignments a
  left join (select user_id, avg({SKIP01}) < 0.25 as hit from sessions group by 1) h on a.user_id = h.user_id) x group by 1) y"""


@query("ab_conversion_chi_square", CHI_COLUMNS, uses="sessions assignments", sql=CHI_SQL)
def ab_conversion_chi_square(m):
    return ex.conversion_test(m.assignments, _low_skippers(m))


def _low_skippers(m):
    return m.results.selectExpr("user_id", "test_name", "metric_value < 0.25 as converted")


@query("ab_conversion_significance", CHI_COLUMNS + ", p_value:d", uses="sessions assignments", ctes=f"ch as ({CHI_SQL})",
       sql=f"select *, 2 * (1 - {phi('sqrt(ch.chi_square)')}) as p_value from ch")
def ab_conversion_significance(m):
    return ex.conversion_significance(m.assignments, _low_skippers(m))
