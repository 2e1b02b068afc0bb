"""A/B tests: design, assignment, analysis, reports.

Results are in long form: one row per user, test and metric. Every analysis
is one aggregation per (test, metric); what follows works on one row each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions.distributions import (
    chi2_one_df_p, normal_cdf, normal_quantile, t_two_sided_p,
)
from earshot.functions.numbers import percent, ratio
from earshot.operators.preparation import hash_share
from earshot.plans.hashpick import mark_picked, stratum_quotas
from earshot.plans.ranks import least_onward, running_totals
from earshot.plans.stored import stored

# Design defaults.
SIGNIFICANCE, POWER, MIN_SAMPLE = 0.05, 0.80, 1000
NO_EFFECT_SAMPLE = 10_000

#: Distinct p values that one window may rank.
FEW = 10_000

_ARMS = ("control", "treatment")


# --- design -----------------------------------------------------------------

def sample_size(baseline: Column, mde: float | Column, power: float = POWER,
                alpha: float = SIGNIFICANCE, zero_effect: int | None = NO_EFFECT_SAMPLE) -> Column:
    """Users needed per arm to see a relative effect on a rate.

    Without an effect the result is ``zero_effect``; None leaves it null.
    """
    mde = mde if isinstance(mde, Column) else F.lit(float(mde))
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    treated = baseline * (1 + mde)
    pooled, effect = (baseline + treated) / 2, F.abs(treated - baseline)
    need = 2 * pooled * (1 - pooled) * F.lit(z * z) / (effect * effect)
    return F.when(effect == 0, F.lit(zero_effect).cast("bigint")).otherwise(F.ceil(need))


def sample_size_of(baseline: float, mde: float, power: float = POWER,
                   alpha: float = SIGNIFICANCE) -> int:
    """The same for plain numbers."""
    treated = baseline * (1 + mde)
    pooled, effect = (baseline + treated) / 2, abs(treated - baseline)
    if effect == 0:
        return NO_EFFECT_SAMPLE
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    return math.ceil(2 * pooled * (1 - pooled) * z * z / effect ** 2)


def create_experiment(name: str, control: DataFrame, treatment: DataFrame,
                      user: str = "user_id") -> DataFrame:
    """Assignments (user_id, test_name, variant) from two sets of users."""
    def arm(users, variant):
        return users.select(F.col(user).alias("user_id"), F.lit(name).alias("test_name"),
                            F.lit(variant).alias("variant"))
    return arm(control, "control").unionByName(arm(treatment, "treatment"))


def assign(users: DataFrame, test_name: str, treatment_ratio: float = 0.5, seed: int = 42,
           exact: bool = False, strata: list[str] | None = None) -> DataFrame:
    """Assign users by hash of seed and id.

    By default each user is decided alone: about ``treatment_ratio`` are
    treated, new users can be added any time, nothing is shuffled. ``exact``
    makes ``floor(n * (1 - ratio))`` control users, ``strata`` does so with
    each stratum in proportion.
    """
    if exact or strata:
        wanted = F.floor(F.col("total") * F.lit(1 - treatment_ratio))
        quotas = (stratum_quotas(users, strata, wanted) if strata else
                  users.agg(F.count("*").alias("total")).select(wanted.alias("quota")))
        marked = mark_picked(users, ["user_id"], quotas, seed, strata or (), "is_control")
        control = F.col("is_control")
    else:
        marked, control = users, hash_share(["user_id"], seed) < 1 - treatment_ratio
    return marked.select("user_id", F.lit(test_name).alias("test_name"),
                         F.when(control, "control").otherwise("treatment").alias("variant"),
                         *(strata or []))


def overlapping_users(assignments: DataFrame) -> DataFrame:
    """Users in more than one arm of a test."""
    return (assignments.groupBy("test_name", "user_id")
            .agg(F.countDistinct("variant").alias("variants")).where(F.col("variants") > 1))


def balance(assignments: DataFrame, treatment_ratio: float = 0.5,
            min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Users per arm, test of the planned ratio (chi-square), and if each arm is large enough."""
    counts = (assignments.groupBy("test_name", "variant").agg(F.countDistinct("user_id").alias("n"))
              .groupBy("test_name").agg(*(F.coalesce(F.sum(F.when(F.col("variant") == arm, F.col("n"))), F.lit(0))
                                          .alias(f"{arm}_n") for arm in _ARMS)))
    total = F.col("control_n") + F.col("treatment_n")
    planned = total * treatment_ratio
    gap = F.col("treatment_n") - planned
    return counts.withColumn("chi_square", ratio(gap * gap, planned, None)
                             + ratio(gap * gap, total - planned, None)) \
        .withColumn("enough_users", F.least("control_n", "treatment_n") >= min_sample)


def balance_test(assignments: DataFrame, treatment_ratio: float = 0.5) -> DataFrame:
    """:func:`balance` with the p value of the ratio."""
    return balance(assignments, treatment_ratio).withColumn("p_value", chi2_one_df_p("chi_square"))


# --- adapters ---------------------------------------------------------------

def to_long(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide results (one column per metric) in long form."""
    return results.select("user_id", "test_name", F.inline(F.array(*(
        F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value"))
        for m in metrics))))


# --- analysis ---------------------------------------------------------------

def arm_summary(assignments: DataFrame, results: DataFrame) -> DataFrame:
    """Users, mean and deviation per test, metric and arm; also users without results."""
    return (assignments.join(results, ["user_id", "test_name"], "left")
            .groupBy("test_name", "metric_name", "variant")
            .agg(F.countDistinct("user_id").alias("users"), F.avg("metric_value").alias("avg_metric"),
                 F.stddev_samp("metric_value").alias("stddev_metric"))
            .orderBy("test_name", "variant"))


def comparison(assignments: DataFrame, results: DataFrame) -> DataFrame:
    """Means and lift of treatment over control per test and metric, both arms present."""
    joined = assignments.join(results, ["user_id", "test_name"])
    aggregates = []
    for arm in _ARMS:
        mine = F.col("variant") == arm
        aggregates += [F.avg(F.when(mine, F.col("metric_value"))).alias(f"{arm}_mean"),
                       F.countDistinct(F.when(mine, F.col("user_id"))).alias(f"{arm}_n")]
    lift = F.col("treatment_mean") - F.col("control_mean")
    return (joined.groupBy("test_name", "metric_name").agg(*aggregates)
            .where((F.col("control_n") > 0) & (F.col("treatment_n") > 0))
            .select("test_name", "metric_name", "control_mean", "treatment_mean",
                    lift.alias("absolute_lift"), percent(lift, "control_mean").alias("relative_lift_pct"),
                    "control_n", "treatment_n"))


def effects(assignments: DataFrame, results: DataFrame, alpha: float = SIGNIFICANCE) -> DataFrame:
    """Per test and metric: means, deviations, effects, Welch t, interval, Cohen's d.

    Null metric values are left out. Effects relative to a zero mean, and d
    without spread, are 0.
    """
    value = F.col("metric_value")
    aggregates = []
    for arm in _ARMS:
        mine = F.when(F.col("variant") == arm, value)
        aggregates += [F.avg(mine).alias(f"{arm}_mean"), F.stddev_samp(mine).alias(f"{arm}_std"),
                       F.count(mine).alias(f"{arm}_n")]
    rows = (results.where(value.isNotNull() & ~F.isnan(value.cast("double")))
            .join(assignments.select("user_id", "test_name", "variant"), ["user_id", "test_name"])
            .groupBy("test_name", "metric_name").agg(*aggregates))
    return _with_effects(rows, alpha)


def effects_from_moments(moments: DataFrame, alpha: float = SIGNIFICANCE) -> DataFrame:
    """The same from n, mean and squared deviations from the mean (``m2``) per test, metric and arm.

    This is what a running stream keeps up to date. Means are counted from ``pivot``, where there is such a column. Several
    rows of an arm are merged: their squared deviations, and those of their means from the whole mean. All differences are
    taken between numbers near zero; the pivot is added to the means at the end.
    """
    given = F.col("pivot") if "pivot" in moments.columns else F.lit(0.0)
    metric = Window.partitionBy("test_name", "metric_name")  # a row per arm and batch at most
    same = Window.partitionBy("test_name", "metric_name", "variant")
    placed = moments.withColumn("origin", F.min(given).over(metric)).withColumn("mean", F.col("mean") + (given - F.col("origin")))
    near = F.min("mean").over(same)  # sums of distances from it do not cancel
    middle = near + ratio(F.sum(F.col("n") * (F.col("mean") - near)).over(same), F.sum("n").over(same), None)
    placed = placed.withColumn("middle", middle)
    aggregates = [F.min("origin").alias("origin")]
    for arm in _ARMS:
        def of(column, arm=arm):
            return F.when(F.col("variant") == arm, column)
        n = F.sum(of(F.col("n")))
        apart = F.col("mean") - F.col("middle")
        spread = F.sum(of(F.col("m2") + F.col("n") * apart * apart))
        aggregates += [F.max(of(F.col("middle"))).alias(f"{arm}_mean"), F.when(n > 1, F.sqrt(ratio(spread, n - 1, None))).alias(f"{arm}_std"),
                       F.coalesce(n, F.lit(0)).alias(f"{arm}_n")]
    return _with_effects(placed.groupBy("test_name", "metric_name").agg(*aggregates), alpha, F.col("origin"))


def _with_effects(rows: DataFrame, alpha: float, origin: Column | None = None) -> DataFrame:
    """``origin``: what the means are counted from."""
    origin = F.lit(0.0) if origin is None else origin
    c = {name: F.col(name) for name in rows.columns}
    n1, n2 = c["control_n"], c["treatment_n"]
    v1, v2 = c["control_std"] * c["control_std"], c["treatment_std"] * c["treatment_std"]
    e1, e2 = ratio(v1, n1, None), ratio(v2, n2, None)
    effect = c["treatment_mean"] - c["control_mean"]
    se = F.sqrt(e1 + e2)
    df = ratio((e1 + e2) * (e1 + e2), ratio(e1 * e1, n1 - 1, None) + ratio(e2 * e2, n2 - 1, None), None)
    pooled = F.sqrt(ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2, None))
    half = F.lit(normal_quantile(1 - alpha / 2)) * se
    # Two constant arms that differ: the difference is beyond any doubt.
    t = F.coalesce(ratio(effect, se, None), F.when((se == 0) & (effect != 0), F.signum(effect) * F.lit(float("inf"))))
    return rows.select(
        "test_name", "metric_name", *((origin + F.col(f"{arm}_mean")).alias(f"{arm}_mean") for arm in _ARMS),
        "control_std", "treatment_std", "control_n", "treatment_n", effect.alias("absolute_effect"),
        F.when(effect.isNotNull(), ratio(effect, origin + c["control_mean"])).alias("relative_effect"),
        se.alias("standard_error"), t.alias("t_statistic"),
        df.alias("degrees_of_freedom"), (effect - half).alias("ci_lower"), (effect + half).alias("ci_upper"),
        F.when(effect.isNotNull() & pooled.isNotNull(), ratio(effect, pooled)).alias("effect_size"))


def significance(effect_rows: DataFrame, alpha: float = SIGNIFICANCE) -> DataFrame:
    """Add the two-sided p value, the verdict and the achieved power.

    Power is what the observed effect and error give, not the planned value.
    """
    z = F.lit(normal_quantile(1 - alpha / 2))
    shift = F.abs(F.col("t_statistic"))
    return (effect_rows.withColumn("p_value", t_two_sided_p("t_statistic", "degrees_of_freedom"))
            .withColumn("is_significant", F.col("p_value") < alpha)
            .withColumn("power", normal_cdf(shift - z) + normal_cdf(-shift - z)))


def analyze(assignments: DataFrame, results: DataFrame, alpha: float = SIGNIFICANCE) -> DataFrame:
    return significance(effects(assignments, results, alpha), alpha)


def adjust_for_many(tests: DataFrame, rate: float = SIGNIFICANCE, p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg: adjusted p values over one row per test and metric, of any number.

    ``rank`` is the number of tests with a p value up to the row's own, so tests that tie share it. The tests are written
    once and become one row per p value. Up to :data:`FEW` of these are ranked by one window; beyond, ranks are totals over
    ranges of p values and the least scaled value from each on runs back over ranges, so no task sees all tests. The rows
    are the same.
    """
    tested = stored(tests.where(F.col(p).isNotNull() & ~F.isnan(p)), "tests")
    values = tested.groupBy(F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_n"))
    total = tested.count()
    scaled = F.col("_p") * total / F.col("rank")
    if values.limit(FEW + 1).count() <= FEW:
        upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        onward = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
        ranked = values.withColumn("rank", F.sum("_n").over(upto)).withColumn("_scaled_onward", F.min(scaled).over(onward))
    else:
        values = stored(values, "p-values")
        ranked = running_totals(values, "_p", ["_n"]).withColumn("rank", F.col("_n_before") + F.col("_n"))
        ranked = least_onward(ranked.withColumn("_scaled", scaled), "_p", "_scaled")
    adjusted = ranked.select("_p", "rank", F.least("_scaled_onward", F.lit(1.0)).alias("adjusted_p"))
    return (tested.join(adjusted, F.col(p).cast("double") == F.col("_p"))
            .withColumn("is_discovery", F.col("adjusted_p") <= rate).drop("_p"))


def conversion_test(assignments: DataFrame, converted: DataFrame) -> DataFrame:
    """Chi-square of a yes/no outcome between the arms (2 x 2, no correction).

    ``converted`` has user_id, test_name and a boolean ``converted``; assigned
    users without a row did not convert.
    """
    outcome = (converted.groupBy("user_id", "test_name")
               .agg(F.max(F.col("converted").cast("int")).alias("hit")))
    counts = (assignments.join(outcome, ["user_id", "test_name"], "left").groupBy("test_name").agg(*(
        F.count_if((F.col("variant") == arm) & (F.coalesce("hit", F.lit(0)) == hit)).alias(f"{arm}_{name}")
        for arm in _ARMS for name, hit in (("yes", 1), ("no", 0)))))
    a, b, c, d = (F.col(f"{arm}_{n}").cast("double") for arm in _ARMS for n in ("yes", "no"))
    total = a + b + c + d
    cross = a * d - b * c
    return counts.withColumn("chi_square", ratio(total * cross * cross, (a + b) * (c + d) * (a + c) * (b + d), None))


def conversion_significance(assignments: DataFrame, converted: DataFrame) -> DataFrame:
    return conversion_test(assignments, converted).withColumn("p_value", chi2_one_df_p("chi_square"))


# --- presentation -----------------------------------------------------------

def report(analysis: DataFrame) -> DataFrame:
    """One text block per test and metric."""
    # Fixed value: the layout of the text.
    rule = "=" * 60
    text = "\n".join([
        "", rule, "A/B TEST: %s", rule, "Control: %,d users, Mean: %.4f", "Treatment: %,d users, Mean: %.4f", "",
        "Effect: %+.4f (%+.2f%%)", "95%% CI: [%.4f, %.4f]", "P-value: %.4f", "Significant: %s", rule, ""])
    return analysis.select("test_name", "metric_name", F.format_string(
        text, "test_name", "control_n", "control_mean", "treatment_n", "treatment_mean",
        "absolute_effect", F.col("relative_effect") * 100, "ci_lower", "ci_upper", "p_value",
        F.when(F.col("is_significant"), "YES").otherwise("NO")).alias("report"))


def arm_intervals(effect_rows: DataFrame) -> DataFrame:
    """Mean, standard error and 95 % bar per arm, as plotted."""
    arms = [F.struct(F.lit(arm.capitalize()).alias("group"), F.col(f"{arm}_mean").alias("mean"),
                     (F.col(f"{arm}_std") / F.sqrt(F.col(f"{arm}_n"))).alias("se")) for arm in _ARMS]
    return (effect_rows.select("test_name", "metric_name", F.inline(F.array(*arms)))
            .withColumn("lower", F.col("mean") - 1.96 * F.col("se"))
            .withColumn("upper", F.col("mean") + 1.96 * F.col("se")))
