"""Model metrics as aggregations over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions.numbers import ratio, sample_kurtosis, sample_skewness
from earshot.plans.ranks import running_totals
from earshot.plans.stored import stored


# --- classification ---------------------------------------------------------

def _confusion(label: str, prediction: str, positive: int = 1) -> dict[str, Column]:
    is_true, said_true = F.col(label) == positive, F.col(prediction) == positive
    return {"tp": F.count_if(is_true & said_true), "fp": F.count_if(~is_true & said_true),
            "fn": F.count_if(is_true & ~said_true), "tn": F.count_if(~is_true & ~said_true)}


def classification_metrics(scored: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, precision, recall and F1; 0 where nothing is predicted or true."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (scored.agg(*(c.alias(n) for n, c in _confusion(label, prediction).items()))
            .select(ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                    ratio(2 * tp, 2 * tp + fp + fn).alias("f1")))


def classification_report(scored: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, in one pass."""
    counts = {f"{n}_{k}": c for k in (0, 1) for n, c in _confusion(label, prediction, k).items()}
    rows = [F.struct(F.lit(k).alias("class"), *(F.col(f"{n}_{k}").alias(n) for n in ("tp", "fp", "fn")))
            for k in (0, 1)]
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (scored.agg(*(c.alias(n) for n, c in counts.items())).select(F.inline(F.array(*rows)))
            .select("class", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                    ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support")))


def _by_score(scored: DataFrame, label: str, score: str) -> DataFrame:
    return scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def auc(scored: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """One row with the exact area under the ROC curve, ties counted half."""
    # Ranking reads the groups several times: stored, they are gathered once.
    ranked = running_totals(stored(_by_score(scored, label, score), "scores"), "score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(ratio(won, pairs, None).alias("auc_roc"))


def roc_curve(scored: DataFrame, label: str = "label", score: str = "probability",
              drop_intermediate: bool = True) -> DataFrame:
    """fpr, tpr and threshold from (0, 0) on; points on a straight line are dropped.

    The first point has an infinite threshold.
    """
    groups = _by_score(scored, label, score)
    points = running_totals(groups, "score", ["pos", "neg"], descending=True, following=["pos", "neg"])
    if drop_intermediate:
        points = points.where(F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    totals = groups.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    curve = points.select(ratio(F.col("neg_before") + F.col("neg"), totals["n"], None).alias("fpr"),
                          ratio(F.col("pos_before") + F.col("pos"), totals["p"], None).alias("tpr"),
                          F.col("score").alias("threshold"))
    start = scored.sparkSession.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                                                F.lit(float("inf")).alias("threshold"))
    return start.unionByName(curve)


# --- regression -------------------------------------------------------------

def regression_metrics(scored: DataFrame, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """One row: R2, RMSE, MAE and MAPE in percent; labels of 0 are left out of MAPE."""
    y = F.col(label).cast("double")
    error = y - F.col(prediction)
    spread = F.var_pop(y) * F.count(y)
    return scored.agg((1 - ratio(F.sum(error * error), spread, None)).alias("r2"),
                      F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
                      (F.avg(F.abs(F.try_divide(error, y))) * 100).alias("mape"))


def residual_summary(scored: DataFrame, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Mean, deviation, range, skewness and kurtosis of label minus prediction."""
    r = scored.select((F.col(label).cast("double") - F.col(prediction)).alias("r"))
    return r.agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("min"),
                 F.max("r").alias("max"), sample_skewness("r").alias("skewness"),
                 sample_kurtosis("r").alias("kurtosis"))


def f_scores(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Univariate F statistic of each feature for a numeric label, in one pass."""
    row = df.agg(F.count(F.col(label)).alias("_n"), *(F.corr(f, label).alias(f) for f in features))
    items = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("correlation"))
                      for f in features))
    r2 = F.col("correlation") * F.col("correlation")
    # A perfectly correlated feature leaves no residual: its score is infinite.
    score = F.when(r2 >= 1, F.lit(float("inf"))).otherwise(ratio(r2 * (F.col("_n") - 2), 1 - r2, None))
    return row.select("_n", F.inline(items)).withColumn("f_score", score).drop("_n")
