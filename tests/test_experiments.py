import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot import ABTestFramework, ExperimentResults
from earshot.operators import experiments as ex


@pytest.fixture
def ab():
    return ABTestFramework(significance_level=0.05)


def metric(rows, control, treatment):
    values = [*control, *treatment]
    df = rows([(f"user_{i}", float(v)) for i, v in enumerate(values)], "user_id string, metric_value double")
    number = F.substring("user_id", 6, 10).cast("int")
    return df, df.where(number < len(control)), df.where(number >= len(control))


def test_sample_size(ab, rows):
    assert ab.calculate_sample_size(0.30, 0.05) == 14_857
    assert ab.calculate_sample_size(0.30, 0.0) == 10_000
    got = rows([(0.30,), (0.0,)], "b double").select(ex.sample_size(F.col("b"), 0.05), ex.sample_size(F.col("b"), 0.05, zero_effect=None)).collect()
    assert [tuple(r) for r in got] == [(14_857, 14_857), (10_000, None)]


def test_create_experiment(ab, spark):
    users = spark.range(1000).select(F.concat(F.lit("user_"), "id").alias("user_id"))
    control, treatment = ab.assign_users_randomly(users, 0.5, 42)
    ab.create_experiment("test_exp", control, treatment, "Test")
    assert "test_exp" in ab.experiments and ab.assignments["test_exp"].count() == 1000
    assert control.count() == treatment.count() == 500 and control.intersect(treatment).count() == 0


def test_hash_assignment(spark):
    users = spark.range(4000).select(F.col("id").alias("user_id"))
    got = {r.variant: r["count"] for r in ex.assign(users, "t", 0.25).groupBy("variant").count().collect()}
    assert got["control"] + got["treatment"] == 4000 and abs(got["treatment"] - 1000) < 120
    exact = {r.variant: r["count"] for r in ex.assign(users, "t", 0.25, exact=True).groupBy("variant").count().collect()}
    assert exact == {"control": 3000, "treatment": 1000}


def test_analysis_matches_closed_forms(ab, rows):
    rng = np.random.default_rng(42)
    a, b = rng.normal(0.30, 0.05, 400), rng.normal(0.31, 0.08, 300)
    df, control, treatment = metric(rows, a, b)
    ab.create_experiment("e", control, treatment)
    got = ab.analyze_results("e", df, "metric_value")
    assert isinstance(got, ExperimentResults) and (got.control_n, got.treatment_n) == (400, 300)
    se = np.sqrt(a.var(ddof=1) / 400 + b.var(ddof=1) / 300)
    assert got.absolute_effect == pytest.approx(b.mean() - a.mean())
    assert got.relative_effect == pytest.approx((b.mean() - a.mean()) / a.mean())
    assert got.confidence_interval == pytest.approx((got.absolute_effect - 1.959964 * se, got.absolute_effect + 1.959964 * se))
    pooled = np.sqrt((399 * a.var(ddof=1) + 299 * b.var(ddof=1)) / 698)
    assert got.effect_size == pytest.approx(got.absolute_effect / pooled)
    dof = se ** 4 / ((a.var(ddof=1) / 400) ** 2 / 399 + (b.var(ddof=1) / 300) ** 2 / 299)
    reference = rows([(1,)], "x int").sparkSession._jvm.org.apache.commons.math3.distribution.TDistribution(float(dof))
    assert got.p_value == pytest.approx(2 * (1 - reference.cumulativeProbability(abs(got.absolute_effect / se))), abs=1e-9)
    assert got.is_significant == (got.p_value < 0.05) and 0 < got.power < 1


def test_large_effect_is_found(ab, rows):
    rng = np.random.default_rng(42)
    df, control, treatment = metric(rows, rng.normal(0.30, 0.05, 1000), rng.normal(0.40, 0.05, 1000))
    ab.create_experiment("sig", control, treatment)
    got = ab.analyze_results("sig", df, "metric_value")
    assert got.is_significant and got.p_value < 0.05 and got.power > 0.99


def test_no_effect_is_small(ab, rows):
    values = np.random.default_rng(42).normal(0.30, 0.1, 1000)
    df, control, treatment = metric(rows, values[:500], values[500:])
    ab.create_experiment("none", control, treatment)
    assert abs(ab.analyze_results("none", df, "metric_value").relative_effect) < 0.1


def test_report(ab, rows):
    df, control, treatment = metric(rows, [0, 1, 0, 1], [1, 1, 0, 1])
    ab.create_experiment("report_test", control, treatment)
    ab.analyze_results("report_test", df, "metric_value")
    text = ab.generate_report("report_test")
    assert all(part in text for part in ("report_test", "Control: 4 users, Mean: 0.5000", "Treatment", "P-value", "(+50.00%)"))


def analysed(rows, data):
    assigned = rows([(u, "t", v) for u, v, _ in data], "user_id string, test_name string, variant string")
    results = rows([(u, "t", "m", x) for u, _, x in data], "user_id string, test_name string, metric_name string, metric_value double")
    return ex.analyze(assigned, results).head()


def test_degenerate_arms(rows):
    zero_mean = analysed(rows, [("a", "control", -1.0), ("b", "control", 1.0), ("c", "treatment", 2.0), ("d", "treatment", 3.0)])
    assert zero_mean.relative_effect == 0.0 and zero_mean.absolute_effect == 2.5
    no_spread = analysed(rows, [("a", "control", 1.0), ("b", "control", 1.0), ("c", "treatment", 2.0), ("d", "treatment", 2.0)])
    assert no_spread.effect_size == 0.0 and no_spread.t_statistic == float("inf")
    assert no_spread.p_value == 0.0 and no_spread.is_significant and no_spread.power == 1.0
    equal = analysed(rows, [("a", "control", 1.0), ("b", "control", 1.0), ("c", "treatment", 1.0), ("d", "treatment", 1.0)])
    assert equal.p_value is None and equal.absolute_effect == 0.0
    empty = analysed(rows, [("a", "control", 1.0), ("b", "control", 2.0)])
    assert empty.treatment_n == 0 and empty.absolute_effect is None and empty.p_value is None
    gaps = analysed(rows, [("a", "control", 1.0), ("b", "control", None), ("e", "control", float("nan")), ("c", "treatment", 2.0)])
    assert (gaps.control_n, gaps.treatment_n) == (1, 1)


def test_moments_of_large_close_values(rows):
    base = 1.7e9
    data = [(f"{arm}{i}", arm, base + i * 1e-3 + (arm == "treatment")) for arm in ("control", "treatment") for i in range(3)]
    moments = rows([("t", "m", arm, 1, x, 0.0) for _, arm, x in data],
                   "test_name string, metric_name string, variant string, n bigint, mean double, m2 double")
    direct, other = analysed(rows, data), ex.effects_from_moments(moments).head()
    assert other.control_std == pytest.approx(1e-3, rel=1e-3) == direct.control_std
    assert other.absolute_effect == pytest.approx(1.0, rel=1e-6)


def test_moments_give_the_same(rows):
    data = [("a", "control", 1.0), ("b", "control", 4.0), ("c", "treatment", 2.0), ("d", "treatment", 6.0), ("e", "treatment", 3.0)]
    moments = rows([("t", "m", "control", 2, 2.5, 4.5), ("t", "m", "treatment", 2, 4.0, 8.0), ("t", "m", "treatment", 1, 3.0, 0.0)],
                   "test_name string, metric_name string, variant string, n bigint, mean double, m2 double")
    direct, other = analysed(rows, data), ex.effects_from_moments(moments).head()
    for name in other.asDict():
        assert other[name] == pytest.approx(direct[name]), name


def test_false_discovery_control(rows):
    p = [0.001, 0.008, 0.039, 0.041, 0.2]
    got = ex.adjust_for_many(rows([(x,) for x in p], "p_value double")).orderBy("p_value").collect()
    assert [r.adjusted_p for r in got] == pytest.approx([0.005, 0.02, 0.05125, 0.05125, 0.2])
    assert [r.is_discovery for r in got] == [True, True, False, False, False]


def test_overlap_and_balance(rows):
    a = rows([("a", "t", "control"), ("a", "t", "treatment"), ("b", "t", "control")], "user_id string, test_name string, variant string")
    assert [r.user_id for r in ex.overlapping_users(a).collect()] == ["a"]
    got = ex.balance_test(a).head()
    assert (got.control_n, got.treatment_n, got.enough_users) == (2, 1, False)
    assert got.chi_square == pytest.approx(1 / 3)


def test_chi_square(rows):
    def people(variant, yes, no):
        return [(f"{variant}{i}", "t", variant, i < yes) for i in range(yes + no)]
    df = rows(people("control", 30, 70) + people("treatment", 45, 55), "user_id string, test_name string, variant string, converted boolean")
    got = ex.conversion_significance(df.drop("converted"), df.drop("variant")).head()
    assert got.chi_square == pytest.approx(4.8, abs=1e-9) and got.p_value == pytest.approx(0.02846, abs=1e-5)
