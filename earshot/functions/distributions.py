"""Normal and Student t tail probabilities as Arrow functions.

Spark SQL has neither; they are only ever applied to result-sized frames,
one row per test.
"""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship these functions with the query, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STANDARD = NormalDist()


def _each(function, values) -> np.ndarray:
    values = np.asarray(values, dtype=float)
    return np.array([function(v) for v in values.ravel()], dtype=float).reshape(values.shape)


def _log_gamma(values) -> np.ndarray:
    return _each(math.lgamma, values)


def _erfc(values) -> np.ndarray:
    return _each(math.erfc, values)


def normal_quantile(p: float) -> float:
    return _STANDARD.inv_cdf(p)


def _log_gamma_step(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """log(gamma(x + a) / gamma(x)) without the cancellation of two large logarithms.

    Stirling's series for the difference, after 16 steps of the recurrence, so that it is exact for small x too.
    """
    steps = sum(np.log1p(a / (x + k)) for k in range(16))
    x = x + 16

    def rest(y):
        return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return (x - 0.5) * np.log1p(a / x) + a * np.log(x + a) - a + rest(x + a) - rest(x) - steps


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray, complement: np.ndarray | None = None) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (DLMF 8.17.22), iterated until it stands still.

    ``complement`` is 1 - x where that is known more precisely than by subtraction.
    """
    y = 1 - np.asarray(x, dtype=float) if complement is None else complement
    x, a, b, y = (np.array(v, dtype=float) for v in np.broadcast_arrays(x, a, b, y))
    swap = x > (a + 1) / (a + b + 2)
    x, y, a, b = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        small, large = np.minimum(a, b), np.maximum(a, b)
        front = np.exp(a * np.where(x < 0.5, np.log(x), np.log1p(-y)) + b * np.where(x < 0.5, np.log1p(-x), np.log(y)) - np.log(a)
                       + _log_gamma_step(large, small) - _log_gamma(small))
        # Lentz's rule: numerators and denominators as running ratios.
        value, c, d, term = np.ones_like(x), np.full_like(x, np.inf), np.ones_like(x), 0
        moving = (x > 0) & np.isfinite(a) & np.isfinite(b)
        while moving.any():
            m = (term + 1) // 2
            part = (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if term % 2
                    else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
            d = 1 / _apart(1 + part * d)
            c = _apart(1 + part / c)
            factor = c * d
            value = np.where(moving, value * factor, value)
            moving &= np.abs(factor - 1) > 2e-16
            term += 1
        value = np.where(x <= 0, 0.0, front * value)
    return np.where(swap, 1 - value, value)


def _apart(v: np.ndarray) -> np.ndarray:
    """Away from zero, for a division."""
    return np.where(np.abs(v) < 1e-300, 1e-300, v)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(invalid="ignore", over="ignore"):
        p = incomplete_beta(df / (df + t * t), df / 2, np.full_like(df, 0.5), t * t / (df + t * t))
    return np.where(np.isinf(t), 0.0, np.where(t == 0, 1.0, p))


@F.pandas_udf(DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p value; null where t or df is missing."""
    t, df = t.astype(float), df.astype(float).where(df.notna() | ~np.isinf(t.fillna(0.0)), 1.0)
    known = (t.notna() & df.notna()).to_numpy()
    out = np.full(len(t), np.nan)
    if known.any():
        out[known] = t_two_sided(t.to_numpy(float)[known], df.to_numpy(float)[known])
    return pd.Series(out).where(pd.Series(known), None)


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """P(Z <= z)."""
    out = pd.Series(0.5 * _erfc(-z.fillna(0).to_numpy(float) / math.sqrt(2)))
    return out.where(z.notna().reset_index(drop=True), None)


@F.pandas_udf(DoubleType())
def chi2_one_df_p(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    out = pd.Series(_erfc(np.sqrt(x.fillna(0).to_numpy(float) / 2)))
    return out.where(x.notna().reset_index(drop=True), None)
