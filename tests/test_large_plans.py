"""Operators over very many groups, tests or columns: exact, and without a task that sees them all."""

import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import experiments as ex, preparation as pr
from earshot.plans import hashpick, ranks, stored


def single_partition_inputs(df) -> list[str]:
    """What is gathered into one partition: the line below each such exchange of the plan."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [plan[i + 1] for i, line in enumerate(plan) if "Exchange SinglePartition" in line] if lines else []


def test_least_onward(spark, rows):
    rng = np.random.default_rng(1)
    data = [(float(i), float(v)) for i, v in enumerate(rng.normal(size=3000))]
    got = {r.x: r.v_onward for r in ranks.least_onward(rows(data, "x double, v double"), "x", "v", buckets=16).collect()}
    least = float("inf")
    for x, v in reversed(data):
        least = min(least, v)
        assert got[x] == least
    assert ranks.least_onward(rows([], "x double, v double"), "x", "v").count() == 0


def plain_adjusted(p):
    """{p: (rank, adjusted)} by the definition."""
    ordered = sorted(p)
    n, least, out = len(p), 1.0, {}
    for i in range(n, 0, -1):
        least = min(least, ordered[i - 1] * n / i)
        rank = out[ordered[i - 1]][0] if ordered[i - 1] in out else i
        out[ordered[i - 1]] = (rank, least)
    return out


@pytest.mark.parametrize("few", [0, ex.FEW])
def test_adjusted_p_values_with_ties(rows, monkeypatch, few):
    monkeypatch.setattr(ex, "FEW", few)
    rng = np.random.default_rng(2)
    p = [0.0, 0.0, 1.0, 1.0, 1.0, *np.round(rng.uniform(size=500) ** 2, 2).tolist()]
    got = ex.adjust_for_many(rows([(i, v) for i, v in enumerate(p)] + [(-1, None), (-2, float("nan"))], "test_name int, p_value double")).collect()
    want = plain_adjusted(p)
    assert len(got) == len(p)
    for r in got:
        rank, adjusted = want[r.p_value]
        # Tied tests share the last rank of their group, whose scaled value is the least of them.
        assert r["rank"] == rank and r.adjusted_p == pytest.approx(adjusted) and r.is_discovery == (r.adjusted_p <= 0.05)
    assert ex.adjust_for_many(rows([], "test_name int, p_value double")).count() == 0


def test_a_million_tests(spark):
    tests = spark.range(1_000_000).select(F.col("id").alias("test_name"), F.pow(F.abs(F.hash("id")) / 2147483648.0, 3.0).alias("p_value"))
    found = ex.adjust_for_many(tests)
    for line in single_partition_inputs(found):
        assert "_bucket" in line, line  # one row per range
    got = found.select("p_value", "rank", "adjusted_p").toPandas().sort_values("p_value")
    p = got["p_value"].to_numpy()
    assert len(p) == 1_000_000
    rank = np.searchsorted(p, p, side="right")
    want = np.minimum(np.minimum.accumulate((p * len(p) / rank)[::-1])[::-1], 1)
    np.testing.assert_array_equal(got["rank"].to_numpy(), rank)
    np.testing.assert_allclose(got["adjusted_p"].to_numpy(), want, rtol=1e-12)


def test_with_rank(rows):
    data = [(i % 7, str(i)) for i in range(500)]
    got = stored.with_rank(rows(data, "a int, b string"), [F.desc("a"), F.asc("b")]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])] == sorted(data, key=lambda d: (-d[0], d[1]))
    assert sorted(r["rank"] for r in got) == list(range(1, 501))


def plain_quotas(sizes, wanted):
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda k: (-(sizes[k] * wanted % total), k is not None, k if k is not None else 0))
    spare = wanted - sum(n * wanted // total for n in sizes.values())
    return {k: sizes[k] * wanted // total + (i < spare) for i, k in enumerate(order)}


@pytest.mark.parametrize("many", [0, 10_000])
def test_quotas_are_the_same_on_both_sides(spark, rows, monkeypatch, many):
    monkeypatch.setattr(hashpick, "MANY_STRATA", many)
    df = rows([(k,) for k in [*range(40)] * 3 + [5] * 11 + [6] * 4 + [None] * 2], "k int")
    sizes = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    got = {r.k: r.quota for r in hashpick.stratum_quotas(df, ["k"], F.floor(F.col("total") * 0.3)).collect()}
    assert got == plain_quotas(sizes, int(sum(sizes.values()) * 0.3))


def test_200_000_strata(spark):
    df = spark.range(500_000).select((F.col("id") % 200_000).alias("k"), "id")
    quotas = hashpick.stratum_quotas(df, ["k"], F.floor(F.col("total") * 0.25))
    for line in single_partition_inputs(quotas):
        assert "_part" in line, line  # one row per range
    got = quotas.toPandas()
    assert len(got) == 200_000 and got["quota"].sum() == 125_000
    # Strata of three rows have 0.75 to come, those of two 0.5: the former go first, then the first of the latter.
    three = got[got["k"] < 100_000]["quota"]
    two = got[got["k"] >= 100_000].sort_values("k")["quota"].to_numpy()
    assert (three == 1).all() and (two[:25_000] == 1).all() and (two[25_000:] == 0).all()


def test_medians_of_many_columns_take_the_rounds_of_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 30_001
    columns = {"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": rng.exponential(size=n), "d": np.repeat(7.0, n)}
    gaps = rng.uniform(size=n) < 0.2
    columns["e"] = np.where(gaps, np.nan, rng.normal(size=n))
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in zip(*columns.values())],
                               ", ".join(f"{c} double" for c in columns)).repartition(4).cache()
    df.count()
    jobs = spark.sparkContext.statusTracker()

    def run(names, group):
        spark.sparkContext.setJobGroup(group, group)
        found = ranks.exact_medians(df, names, small=100)
        spark.sparkContext.setJobGroup("", "")
        return found, len(jobs.getJobIdsForGroup(group))
    found, many = run(list(columns), "many")
    for c, values in columns.items():
        assert found[c] == statistics.median(values[~np.isnan(values)].tolist())
    _, one = run(["a"], "one")
    assert many <= 2 * one  # the slowest column decides, not their number
    df.unpersist()


def test_one_repeated_key_moves_nothing_else(rows):
    data = [(i, f"v{i}") for i in range(1000)]
    key = ["id"]
    first = {r.v for r in pr.sample(rows(data, "id int, v string"), n=100, key=key).collect()}
    again = [r.v for r in pr.sample(rows([*data, (5, "other")], "id int, v string"), n=100, key=key).collect()]
    assert len(again) == 100 and len(first & set(again)) >= 98
    marked = pr.mark_split(rows([*data, (5, "other"), (5, "other")], "id int, v string"), key).collect()
    assert len(marked) == 1002 and sum(r.is_test for r in marked) == 201
