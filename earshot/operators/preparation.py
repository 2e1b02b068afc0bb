"""Sampling, missing values, splits, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from earshot.plans.hashpick import mark_picked, row_hash, stratum_quotas
from earshot.plans.ranks import exact_medians

STRATEGIES = ("drop", "fill", "mean", "median", "mode")


# --- sampling ---------------------------------------------------------------

def sample(df: DataFrame, n: int | None = None, frac: float | None = None, seed: int = 42,
           key: list[str] | None = None) -> DataFrame:
    """``n`` rows, or about ``frac`` of them, or everything.

    Rows are picked by hash of ``key`` (all columns by default), so a task that
    runs again picks the same. A row count is exact, also where rows share the
    key; see :mod:`earshot.plans.hashpick`.
    """
    key = key or df.columns
    if n is not None:
        quota = df.agg(F.least(F.count("*"), F.lit(n)).alias("quota"))
        return mark_picked(df, key, quota, seed).where("picked").drop("picked")
    return df if frac is None else df.where(hash_share(key, seed) < frac)


# --- missing values ---------------------------------------------------------

def _known(df: DataFrame, column: str) -> Column:
    """The column, null where it is NaN: both count as missing everywhere."""
    if isinstance(df.schema[column].dataType, (DoubleType, FloatType)):
        return F.when(~F.isnan(F.col(f"`{column}`")), F.col(f"`{column}`"))
    return F.col(f"`{column}`")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row with the number of missing values (null or NaN) per column."""
    return df.agg(*(F.count_if(_known(df, c).isNull()).alias(c) for c in columns or df.columns))


def _numeric(df: DataFrame, columns: list[str]) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if isinstance(kinds[c], NumericType)]


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, missing ones aside, the smallest on a tie.

    Values are counted by a grouped aggregation; a single mode aggregate would
    hold every distinct value in one buffer.
    """
    modes = {}
    for c in columns:
        top = (df.where(_known(df, c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
               .orderBy(F.desc("_n"), c).select(c).head())
        modes[c] = top[0] if top else None
    return modes


def handle_missing(df: DataFrame, strategy: str = "drop", fill_value=None,
                   columns: list[str] | None = None) -> DataFrame:
    """Drop rows with gaps or fill them: constant, mean, exact median or mode.

    Mean and median touch numeric columns only. A column without any value
    stays as it is.
    """
    columns = columns or df.columns
    if strategy == "drop":
        return df.dropna(subset=columns)
    if strategy == "fill":
        if fill_value is None:
            raise ValueError("strategy 'fill' needs a fill_value")
        return df.fillna(fill_value, subset=columns)
    if strategy == "mean":
        numeric = _numeric(df, columns)
        row = df.agg(*(F.avg(_known(df, c)).alias(c) for c in numeric)).head() if numeric else {}
        values = {c: row[c] for c in numeric}
    elif strategy == "median":
        numeric = _numeric(df, columns)
        values = exact_medians(df.select(*(_known(df, c).alias(c) for c in numeric)), numeric)
    elif strategy == "mode":
        values = column_modes(df, columns)
    else:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    return df.withColumns({c: F.coalesce(_known(df, c), F.lit(v)) for c, v in values.items() if v is not None})


# --- splits -----------------------------------------------------------------

def mark_split(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 42,
               stratify: str | None = None, flag: str = "is_test") -> DataFrame:
    """Exact split: ``ceil(n * test_size)`` rows are test rows, per class in proportion."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    wanted = F.ceil(F.col("total") * F.lit(float(test_size)))
    strata = [stratify] if stratify else []
    if strata:
        quotas = stratum_quotas(df, strata, wanted)
    else:
        quotas = df.agg(F.count("*").alias("total")).select(wanted.alias("quota"))
    return mark_picked(df, key, quotas, seed, strata, flag)


def train_test_split(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 42,
                     stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) by :func:`mark_split`."""
    marked = mark_split(df, key, test_size, seed, stratify)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def hash_share(key: list[str], seed: int) -> Column:
    """A row's hash as a number in [0, 1)."""
    return F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


# --- scaling ----------------------------------------------------------------

def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z scores by population deviation; a constant column becomes 0, missing values stay."""
    row = df.agg(*(F.struct(F.avg(_known(df, c)).alias("m"), F.stddev_pop(_known(df, c)).alias("s")).alias(c) for c in columns)).head()
    return df.withColumns({c: (F.col(c) - F.lit(row[c]["m"])) / F.lit(row[c]["s"] or 1.0) for c in columns
                           if row[c]["m"] is not None})


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns mapped to [0, 1]; a constant column becomes 0, missing values stay."""
    row = df.agg(*(F.struct(F.min(_known(df, c)).alias("a"), F.max(_known(df, c)).alias("b")).alias(c) for c in columns)).head()
    return df.withColumns({c: (F.col(c) - F.lit(row[c]["a"])) / F.lit(float((row[c]["b"] - row[c]["a"]) or 1.0))
                           for c in columns if row[c]["a"] is not None})
