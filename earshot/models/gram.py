"""Linear models of many folds from one scan: second moments by fold, and what follows from them.

A fit of least squares, ridge or lasso needs no rows, only the means and the products of deviations of features and label;
so does its error on other rows. These moments are one aggregate by fold. Those of a training part are the merged moments
of the other folds, so ``k`` fits and their scores need one pass over the rows instead of several passes a fold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

_STEPS, _PRECISION = 10_000, 1e-13  # of the lasso's coordinate descent


@dataclass
class Moments:
    """Rows, means, and sums of products of deviations from them; the label is the last column."""

    n: int
    mean: np.ndarray
    spread: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        """The moments of both sets of rows; deviations are kept, never sums of squares, so nothing cancels."""
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.spread + other.spread + np.outer(apart, apart) * (self.n * other.n / n))


def moments_by(df: DataFrame, features: list[str], label: str, fold: str) -> dict[int, Moments]:
    """Moments by fold in one aggregate; features and label must be numbers without gaps.

    The number of aggregates grows with the square of the number of features, the result with the number of folds.
    """
    names = [*features, label]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = df.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))) for c in names)).alias("known"),
        F.array(*(F.avg(c) for c in names)).alias("mean"),
        F.array(*(F.covar_pop(names[i], names[j]) * F.count(F.lit(1)) for i, j in pairs)).alias("spread")).collect()
    out = {}
    for row in found:
        gaps = [c for c, known in zip(names, row["known"]) if known < row["n"]]
        if gaps:
            raise ValueError(f"columns with missing values or NaN: {gaps}")
        spread = np.empty((len(names), len(names)))
        for (i, j), value in zip(pairs, row["spread"]):
            spread[i, j] = spread[j, i] = value
        out[row[fold]] = Moments(row["n"], np.array(row["mean"]), spread)
    return out


@dataclass
class Line:
    """A fitted linear model in the units of its features."""

    slopes: np.ndarray
    mean: np.ndarray  # of features and label, where the line passes through

    def squared_errors(self, rows: Moments) -> float:
        """Sum of squared errors on the rows of these moments."""
        b = self.slopes
        off = rows.mean[-1] - self.mean[-1] - b @ (rows.mean[:-1] - self.mean[:-1])
        inside = rows.spread[-1, -1] - 2 * b @ rows.spread[:-1, -1] + b @ rows.spread[:-1, :-1] @ b
        return float(inside + rows.n * off * off)

    def r2(self, rows: Moments) -> float | None:
        """Share of the label's spread on these rows that the line explains; None without spread."""
        return 1 - self.squared_errors(rows) / float(rows.spread[-1, -1]) if rows.n and rows.spread[-1, -1] > 0 else None


def fit(train: Moments, kind: str, alpha: float) -> Line:
    """Least squares on features scaled by their deviation; a constant feature gets no slope.

    ``ridge`` adds ``alpha`` times the squared slopes to the squared errors, ``lasso`` ``alpha`` times the absolute ones to
    half the mean squared error, both in units of scaled features.
    """
    n, p = train.n, len(train.mean) - 1
    scale = np.sqrt(np.diag(train.spread)[:p] / max(n, 1))
    used = np.flatnonzero(scale > 0)
    own = train.spread[np.ix_(used, used)] / np.outer(scale[used], scale[used])
    pull = train.spread[used, -1] / scale[used]
    if kind == "ridge":
        slopes = np.linalg.solve(own + alpha * np.eye(len(used)), pull) if len(used) else pull
    elif kind == "lasso":
        slopes = _lasso(own / n, pull / n, alpha)
    else:
        slopes = np.linalg.lstsq(own, pull, rcond=None)[0] if len(used) else pull
    whole = np.zeros(p)
    whole[used] = slopes / scale[used]
    return Line(whole, train.mean)


def _lasso(own: np.ndarray, pull: np.ndarray, alpha: float) -> np.ndarray:
    """Coordinate descent: each slope in turn takes its best value, until none moves."""
    slopes = np.zeros(len(pull))
    for _ in range(_STEPS):
        moved = 0.0
        for j in range(len(pull)):
            rest = pull[j] - own[j] @ slopes + own[j, j] * slopes[j]
            best = np.sign(rest) * max(abs(rest) - alpha, 0.0) / own[j, j]
            moved, slopes[j] = max(moved, abs(best - slopes[j])), best
        if moved <= _PRECISION * max(1.0, np.abs(slopes).max(initial=0.0)):
            break
    return slopes


def held_out_r2(folds: dict[int, Moments], kind: str, alpha: float) -> dict[int, float | None]:
    """For each fold the r2 of the model fitted on all others; None where a side has no rows."""
    out = {}
    for k in sorted(folds):
        others = [m for j, m in folds.items() if j != k]
        out[k] = fit(reduce(Moments.__add__, others), kind, alpha).r2(folds[k]) if others else None
    return out
