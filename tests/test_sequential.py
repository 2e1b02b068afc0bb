"""Always-valid verdicts: closed forms, odd looks, and how often no effect is called one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import sequential as sq

SCHEMA = "test_name string, metric_name string, variant string, day date, n long, mean double, m2 double"


def daily(spark, values, pivot=None):
    """``values``: {day number: (control values, treatment values)}."""
    import datetime as dt
    rows = []
    for day, arms in values.items():
        for variant, x in zip(("control", "treatment"), arms):
            x = np.asarray(x, dtype=float)
            if len(x):
                rows.append(("t", "m", variant, dt.date(2024, 1, 1) + dt.timedelta(day), len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())))
    df = spark.createDataFrame(rows, SCHEMA)
    return df if pivot is None else df.selectExpr("*", f"{pivot}D as pivot")


def looks(df, **more):
    return df and sq.looks(df, **{"scale": 1.0, **more}).orderBy("day").collect()


def plain(values, scale=1.0, alpha=0.05):
    a, b, p, out = [], [], 1.0, []
    for x, y in values.values():
        a, b = [*a, *x], [*b, *y]
        effect, error = np.mean(b) - np.mean(a), np.var(a, ddof=1) / len(a) + np.var(b, ddof=1) / len(b)
        ratio = 0.5 * math.log(error / (error + scale ** 2)) + scale ** 2 * effect ** 2 / (2 * error * (error + scale ** 2))
        p = min(p, math.exp(-ratio))
        half = math.sqrt(error * (error + scale ** 2) / scale ** 2 * (2 * math.log(1 / alpha) + math.log((error + scale ** 2) / error)))
        out.append((len(a), len(b), effect, ratio, p, effect - half, effect + half))
    return out


@pytest.mark.parametrize("offset", [0.0, 1.7e9])
def test_against_plain(spark, offset):
    rng = np.random.default_rng(3)
    values = {d: (rng.normal(0, 2, 30), rng.normal(0.8, 3, 25)) for d in range(12)}
    got = looks(daily(spark, values, offset))
    for r, want in zip(got, plain(values)):
        assert (r.control_n, r.treatment_n) == want[:2]
        assert (r.effect, r.log_ratio, r.p_value, r.ci_lower, r.ci_upper) == pytest.approx(want[2:], rel=1e-9)
    assert [r.look for r in got] == list(range(1, 13))


def test_a_verdict_stays(spark):
    values = {0: ([0.0, 0.1] * 50, [3.0, 3.1] * 50), 1: ([9.0, -9.0] * 50, [9.0, -9.0] * 50), 2: ([0.0, 1.0], [])}
    got = looks(daily(spark, values))
    assert [r.verdict for r in got] == ["treatment wins"] * 3
    assert got[1].p_value == got[0].p_value < 1e-6
    turned = {d: (b, a) for d, (a, b) in values.items() if d < 2}
    assert looks(daily(spark, turned))[0].verdict == "control wins"


def test_odd_looks(spark):
    got = looks(daily(spark, {0: ([1.0], [2.0]), 1: ([], [2.0]), 2: ([1.0], [2.0])}))
    assert [(r.p_value, r.verdict) for r in got] == [(1.0, "continue"), (1.0, "continue"), (0.0, "treatment wins")]
    same = looks(daily(spark, {0: ([1.0, 1.0], [1.0, 1.0])}))
    assert (same[0].p_value, same[0].verdict, same[0].effect) == (1.0, "continue", 0.0)
    only = looks(daily(spark, {0: ([1.0, 2.0], [])}))
    assert (only[0].effect, only[0].p_value, only[0].treatment_n) == (None, 1.0, 0)
    assert sq.looks(daily(spark, {0: ([1.0], [1.0])}).limit(0), 1.0).collect() == []
    with pytest.raises(ValueError):
        sq.looks(daily(spark, {0: ([1.0], [1.0])}), 0.0)


def test_earlier_looks_do_not_change(spark):
    rng = np.random.default_rng(4)
    values = {d: (rng.normal(5, 2, 20), rng.normal(6, 2, 20)) for d in range(8)}
    first = looks(daily(spark, {d: values[d] for d in range(4)}))
    assert looks(daily(spark, values))[:4] == first


def test_no_effect_is_rarely_called_one(spark):
    # 400 tests without an effect, read on each of 20 days: far fewer than the fifth that daily t tests would call.
    rng = np.random.default_rng(5)
    import datetime as dt
    rows = []
    for t in range(400):
        for day in range(20):
            for variant in ("control", "treatment"):
                x = rng.normal(0, 1, 25)
                rows.append((f"t{t}", "m", variant, dt.date(2024, 1, 1) + dt.timedelta(day), 25, float(x.mean()), float(((x - x.mean()) ** 2).sum())))
    found = sq.looks(spark.createDataFrame(rows, SCHEMA), scale=0.2).where("verdict <> 'continue'").select("test_name").distinct().count()
    assert found <= 0.08 * 400


def test_monitor_of_the_object_interface(spark, rows):
    from earshot import ABTestFramework

    rng = np.random.default_rng(6)
    users = spark.range(400).select(F.col("id").alias("user_id"))
    ab = ABTestFramework()
    ab.create_experiment("live", users.where("user_id < 200"), users.where("user_id >= 200"))
    data = [(int(u), f"2024-01-{d + 1:02d} 10:00:00", float(rng.normal(100 + (u >= 200) * 2, 3))) for d in range(6) for u in rng.integers(0, 400, 100)]
    frame = rows(data, "user_id long, t string, minutes double").withColumn("timestamp", F.to_timestamp("t"))
    got = ab.monitor("live", frame, "minutes", scale=2.0, expected=100.0).orderBy("look").collect()
    assert [r.look for r in got] == list(range(1, 7)) and got[-1].verdict == "treatment wins"
    assert got[-1].control_n + got[-1].treatment_n == 600
