"""Watching a running test: a verdict after every look that stays valid however often one looks.

A test that is planned for one analysis finds an effect too often if it is read daily. Here each look compares the
likelihood of the data under effects drawn from a normal distribution of deviation ``scale`` with that under no effect (a
mixture ratio). Under no effect the ratio exceeds 1 / alpha at any time with probability alpha at most, so one may stop at
the first look at which it does. It needs only n, mean and squared deviations of both arms so far.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions.numbers import ratio
from earshot.operators.experiments import SIGNIFICANCE, _ARMS

# The verdicts.
GO_ON, TREATMENT, CONTROL = "continue", "treatment wins", "control wins"


def _so_far(daily: DataFrame) -> DataFrame:
    """One row per test, metric and day: n, mean (from ``origin``) and sample variance of each arm up to that day.

    Sums are taken of distances from the first day's mean, which lies near all others, so they do not cancel; it does not
    change as days are added, so earlier looks stay as they were.
    """
    given = F.col("pivot") if "pivot" in daily.columns else F.lit(0.0)
    metric = Window.partitionBy("test_name", "metric_name").orderBy("day")  # a row per day and arm
    ordered = Window.partitionBy("test_name", "metric_name").orderBy("day", "variant")
    placed = daily.withColumn("origin", F.first(given).over(metric)).withColumn("mean", F.col("mean") + (given - F.col("origin")))
    placed = placed.withColumn("near", F.first("mean").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    apart = F.col("mean") - F.col("near")
    sums = []
    for arm in _ARMS:
        def total(value, arm=arm):
            return F.coalesce(F.sum(F.when(F.col("variant") == arm, value)), F.lit(0))
        sums += [total(F.col("n")).alias(f"{arm}_n"), total(F.col("n") * apart).alias(f"{arm}_s"),
                 total(F.col("m2") + F.col("n") * apart * apart).alias(f"{arm}_q")]
    days = placed.groupBy("test_name", "metric_name", "day").agg(F.min("origin").alias("origin"), F.min("near").alias("near"), *sums)
    upto = metric.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns({f"{arm}_{c}": F.sum(f"{arm}_{c}").over(upto) for arm in _ARMS for c in "nsq"})
    columns = {}
    for arm in _ARMS:
        n, s, q = (F.col(f"{arm}_{c}") for c in "nsq")
        columns[f"{arm}_mean"] = F.col("near") + ratio(s, n, None)
        columns[f"{arm}_var"] = F.when(n > 1, F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))
    return days.withColumns(columns).withColumn("look", F.row_number().over(metric))


def log_mixture_ratio(effect: Column, error: Column, scale: float) -> Column:
    """Log likelihood ratio of a normal mixture of effects against none, for an effect with variance ``error``."""
    tau = scale * scale
    wide = error + tau
    return 0.5 * F.log(error / wide) + tau * effect * effect / (2 * error * wide)


def looks(daily: DataFrame, scale: float, alpha: float = SIGNIFICANCE) -> DataFrame:
    """One row per test, metric and day with data: sizes, effect, always-valid p value and interval, verdict.

    ``daily``: test_name, metric_name, variant, day, n, mean, m2 and, if means are counted from it, ``pivot``
    (``live.daily_moments``). ``scale`` is the size of effect that the test is meant to find. The p value is the least
    of all looks so far; the interval covers the effect at all looks at once with probability 1 - alpha. A verdict once
    reached stays. Looks at which an arm has fewer than two values leave the p value as it was, 1 at first. Two constant
    arms that differ are told apart at once.
    """
    if scale <= 0 or not 0 < alpha < 1:
        raise ValueError("scale must be above 0 and alpha between 0 and 1")
    tau = scale * scale
    c = _so_far(daily)
    effect = F.col("treatment_mean") - F.col("control_mean")
    error = ratio(F.col("control_var"), F.col("control_n"), None) + ratio(F.col("treatment_var"), F.col("treatment_n"), None)
    told = c.withColumns({"effect": effect, "error": error})
    effect, error = F.col("effect"), F.col("error")
    constant = F.when(effect == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    told = told.withColumn("log_ratio", F.when(error > 0, log_mixture_ratio(effect, error, scale)).when(error == 0, constant))
    half = F.when(error > 0, F.sqrt(error * (error + tau) / tau * (2 * math.log(1 / alpha) + F.log((error + tau) / error)))).when(error == 0, 0.0)
    upto = Window.partitionBy("test_name", "metric_name").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    now = F.least(F.lit(1.0), F.exp(-F.col("log_ratio")))
    told = told.withColumns({"p_value": F.coalesce(F.min(now).over(upto), F.lit(1.0)), "half": half})
    side = F.when(F.col("log_ratio") >= math.log(1 / alpha), F.when(effect > 0, TREATMENT).otherwise(CONTROL))
    return told.select(
        "test_name", "metric_name", "day", "look", "control_n", "treatment_n", "effect", "log_ratio", "p_value",
        (effect - F.col("half")).alias("ci_lower"), (effect + F.col("half")).alias("ci_upper"),
        F.coalesce(F.first(side, ignorenulls=True).over(upto), F.lit(GO_ON)).alias("verdict"))
