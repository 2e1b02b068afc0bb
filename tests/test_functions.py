
import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import distributions as di, numbers as nu, times as ti


def one(df):
    return df.head()[0]


@pytest.fixture
def stamps(rows):
    return rows([("2024-03-01 12:00:00", "2024-03-01 00:00:00")], "a string, b string").select(
        F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))


def test_floor_days_goes_down(stamps):
    assert one(stamps.select(ti.floor_days("b", "a"))) == -1
    assert one(stamps.select(ti.floor_days("a", "b"))) == 0


@pytest.mark.parametrize("start,end,period,want", [
    ("2023-01-01", "2024-02-01", "monthly", 13),
    ("2023-12-25", "2024-01-08", "weekly", 2),
    ("2023-10-01", "2024-04-01", "quarterly", 2),
    ("2024-05-01", "2024-04-01", "monthly", -1),
])
def test_periods_between(rows, start, end, period, want):
    df = rows([(start, end)], "s string, e string").select(F.to_date("s").alias("s"), F.to_date("e").alias("e"))
    assert one(df.select(ti.periods_between("s", "e", period))) == want


def test_period_labels(rows):
    d = rows([("2024-04-01",)], "d string").select(F.to_date("d").alias("d"))
    assert one(d.select(ti.period_label("d", "monthly"))) == "2024-04"
    assert one(d.select(ti.period_label("d", "quarterly"))) == "2024Q2"
    assert one(d.select(ti.period_label("d", "weekly"))) == "2024-04-01/2024-04-07"
    with pytest.raises(ValueError):
        ti.period_start("d", "daily")


def test_right_closed_bins(rows):
    df = rows([(0.0,), (0.33,), (0.34,), (1.0,), (1.1,), (None,)], "x double")
    got = [r[0] for r in df.select(ti.right_closed_bin("x", [0, 0.33, 0.66, 1], ["L", "M", "H"])).collect()]
    assert got == [None, "L", "M", "H", None, None]


def test_weekend_counts_from_monday(rows):
    df = rows([("2024-01-05",), ("2024-01-06",), ("2024-01-07",), ("2024-01-08",)], "d string")
    assert [r[0] for r in df.select(ti.is_weekend(F.to_timestamp("d"))).collect()] == [False, True, True, False]


def test_ratio_and_rounding(rows):
    df = rows([(1.0, 0.0)], "a double, b double")
    assert one(df.select(nu.ratio("a", "b"))) == 0.0
    assert one(df.select(nu.ratio("a", "b", None))) is None
    assert one(df.select(nu.round_half_up(F.lit(0.285)))) == 0.29
    assert one(df.select(nu.clip(F.lit(None).cast("double"), 0, 1))) is None
    assert one(df.select(nu.clip(F.lit(3.0), 0, 1))) == 1.0


@pytest.mark.parametrize("ms,want", [(5_000, "5.0s"), (90_000, "1.5m"), (7_200_000, "2.0h"), (None, None)])
def test_format_duration(rows, ms, want):
    assert one(rows([(ms,)], "ms bigint").select(nu.format_duration("ms"))) == want


@pytest.mark.parametrize("n,want", [(12.0, "12.0"), (1500.0, "1.5K"), (-2.5e6, "-2.5M"), (3e9, "3.0B")])
def test_format_number(rows, n, want):
    assert one(rows([(n,)], "n double").select(nu.format_number("n"))) == want


def test_corrected_moments_match_pandas(rows):
    import pandas as pd
    values = [1.0, 2.0, 2.5, 7.0, 11.0, 30.0]
    got = rows([(v,) for v in values], "x double").agg(nu.sample_skewness("x"), nu.sample_kurtosis("x")).head()
    assert got[0] == pytest.approx(pd.Series(values).skew())
    assert got[1] == pytest.approx(pd.Series(values).kurtosis())
    few = rows([(1.0,), (2.0,)], "x double").agg(nu.sample_skewness("x"), nu.sample_kurtosis("x")).head()
    assert tuple(few) == (None, None)


@pytest.mark.parametrize("df", [1.0, 2.5, 10.0, 300.0, 19_999.0, 20_001.0, 5e6])
@pytest.mark.parametrize("t", [0.0, 0.3, 1.96, 4.0, -2.0])
def test_student_t_matches_commons_math(spark, t, df):
    reference = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df))
    want = 2 * (1 - reference.cumulativeProbability(abs(t)))
    assert float(di.t_two_sided(np.array([t]), np.array([df]))[0]) == pytest.approx(want, abs=1e-8)


def test_distribution_columns(rows):
    df = rows([(2.0, 10.0), (None, 10.0)], "t double, df double")
    p, missing = [r[0] for r in df.select(di.t_two_sided_p("t", "df")).collect()]
    assert 1 - p / 2 == pytest.approx(0.96331, abs=1e-5) and missing is None
    assert one(df.select(di.normal_cdf(F.lit(1.959964)))) == pytest.approx(0.975, abs=1e-6)
    assert one(df.select(di.chi2_one_df_p(F.lit(3.841459)))) == pytest.approx(0.05, abs=1e-6)
