"""Column functions on numbers, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(top: Column | str, bottom: Column | str, default: float | None = 0.0) -> Column:
    """``top / bottom`` as double; ``default`` where the denominator is 0 or null."""
    top, bottom = _col(top).cast("double"), _col(bottom).cast("double")
    result = F.try_divide(top, bottom)
    return result if default is None else F.coalesce(result, F.lit(float(default)))


def round_half_up(value: Column | str, digits: int = 2) -> Column:
    """Decimal rounding, so that 0.285 gives 0.29 whatever its binary form is."""
    return F.round(_col(value).cast("decimal(30,12)"), digits).cast("double")


def percent(top: Column | str, bottom: Column | str, digits: int = 2) -> Column:
    """``100 * top / bottom`` rounded; null where the denominator is 0."""
    return round_half_up(ratio(top, bottom, None) * 100, digits)


def clip(value: Column | str, low: float, high: float) -> Column:
    """Limit to ``[low, high]``; null stays null."""
    value = _col(value).cast("double")
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low))))


def share_entropy(share: Column) -> Column:
    """One term of the base-2 entropy; 0 for an empty share."""
    return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)


def skip_flag(skipped: Column | str = "skipped") -> Column:
    """1 for a skipped play, else 0; null counts as not skipped."""
    return F.when(_col(skipped), 1).otherwise(0)


def mapped(value: Column | str, codes: dict[str, float], default: float) -> Column:
    """Look a value up in a small fixed table."""
    value = _col(value)
    chain = None
    for key, code in codes.items():
        chain = F.when(value == key, code) if chain is None else chain.when(value == key, code)
    return chain.otherwise(default)


def format_duration(ms: Column | str) -> Column:
    """Milliseconds as ``12.3s``, ``4.5m`` or ``1.2h``."""
    seconds = _col(ms).cast("double") / 1000
    return (F.when(seconds < 60, F.format_string("%.1fs", seconds))
            .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
            .when(seconds.isNotNull(), F.format_string("%.1fh", seconds / 3600)))


def format_number(value: Column | str, precision: int = 1) -> Column:
    """Number with a K, M or B suffix."""
    value = _col(value).cast("double")
    size, pattern = F.abs(value), f"%.{precision}f"
    return (F.when(size >= 1e9, F.format_string(pattern + "B", value / 1e9))
            .when(size >= 1e6, F.format_string(pattern + "M", value / 1e6))
            .when(size >= 1e3, F.format_string(pattern + "K", value / 1e3))
            .when(size.isNotNull(), F.format_string(pattern, value)))


def sample_skewness(value: Column | str) -> Column:
    """Aggregate: skewness corrected for bias; null below three values."""
    value = _col(value)
    n = F.count(value).cast("double")
    return F.when(n >= 3, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(value: Column | str) -> Column:
    """Aggregate: excess kurtosis corrected for bias; null below four values."""
    value = _col(value)
    n = F.count(value).cast("double")
    return F.when(n >= 4, ((n + 1) * F.kurtosis(value) + 6) * (n - 1) / ((n - 2) * (n - 3)))
