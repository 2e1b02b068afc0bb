"""Global order on large data: running totals and exact order statistics."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.plans.stored import stored

_ACCURACY = 10_000

#: Rows that one range may hold before more ranges are made.
_ROWS = 1_000_000


def _cuts(df: DataFrame, order: str, buckets: int) -> tuple[list, int]:
    """Values that cut the rows into near equal ranges, and the number of rows, in one pass."""
    points = [i / buckets for i in range(1, buckets)]
    found, n = df.select(F.percentile_approx(order, points, max(_ACCURACY, 20 * buckets)), F.count("*")).head()
    return found or [], n


def _ranged(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """``df`` with ``_bucket``: ranges of near equal numbers of rows, none of more than about :data:`_ROWS`."""
    cuts, n = _cuts(df, order, buckets)
    if n > buckets * _ROWS:
        cuts, _ = _cuts(df, order, -(-n // _ROWS))
    if not cuts:
        return df.withColumn("_bucket", F.lit(0.0))
    splits = [float("-inf"), *sorted(set(float(c) for c in cuts)), float("inf")]
    return (Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket", handleInvalid="keep")
            .transform(df.withColumn("_order", F.col(order).cast("double"))).drop("_order"))


def running_totals(df: DataFrame, order: str, sums: list[str], descending: bool = False,
                   buckets: int = 512, following: list[str] = ()) -> DataFrame:
    """Add ``<name>_before``: the sum of ``name`` over all rows earlier in order.

    ``following`` names columns whose value in the next row in order is added
    as ``next_<name>``, null in the last row. ``df`` must have one row per
    value of the numeric column ``order``. Rows go to ranges of near equal
    size, ``buckets`` of them or more, so that none holds more than about
    :data:`_ROWS` rows; totals per range are accumulated over one row per
    range, rows within their range. One window over everything would put all
    rows into a single task.
    """
    ranged = _ranged(df, order, buckets)
    bucket_order, row_order = (F.desc("_bucket"), F.desc(order)) if descending else ("_bucket", order)
    over_buckets, inside = Window.orderBy(bucket_order), Window.partitionBy("_bucket").orderBy(row_order)
    earlier, above = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (over_buckets, inside))
    own = F.struct(*following) if following else F.lit(None).cast("int")
    first = (F.max_by if descending else F.min_by)(own, F.col(order)).alias("_first")
    totals = (ranged.groupBy("_bucket").agg(*(F.sum(s).alias(s) for s in sums), first)
              .select("_bucket", *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}") for s in sums),
                      F.lead("_first").over(over_buckets).alias("_after")))
    out = ranged.join(totals, "_bucket")
    added = {f"{s}_before": F.col(f"_{s}") + F.coalesce(F.sum(s).over(above), F.lit(0)) for s in sums}
    if following:
        added["_next"] = F.coalesce(F.lead(own).over(inside), F.col("_after"))
    out = out.withColumns(added)
    out = out.withColumns({f"next_{c}": F.col(f"_next.{c}") for c in following}) if following else out
    return out.drop("_bucket", "_after", "_next", *(f"_{s}" for s in sums))


def least_onward(df: DataFrame, order: str, value: str, buckets: int = 512) -> DataFrame:
    """Add ``<value>_onward``: the least ``value`` of this row and all later ones in order.

    Runs from the far end as :func:`running_totals` does from the near one: the least of each range, accumulated over one
    row per range, meets the least of the rows behind inside the range. ``df`` must have one row per value of ``order``.
    """
    ranged = _ranged(df, order, buckets)
    later = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("_bucket").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    ends = (ranged.groupBy("_bucket").agg(F.min(value).alias("_least"))
            .select("_bucket", F.min("_least").over(later).alias("_later")))
    return (ranged.join(ends, "_bucket").withColumn(f"{value}_onward", F.least(F.min(value).over(behind), F.col("_later")))
            .drop("_bucket", "_later"))


class _Search:
    """Where the value of one rank among the ``held`` values strictly between ``low`` and ``high`` is looked for.

    ``before`` values are known to lie at or below ``low``; ``found`` ends the search.
    """

    def __init__(self, column: str, rank: int, n: int):
        self.column, self.rank, self.held = column, rank, n
        self.low = self.high = self.found = None
        self.before = 0

    def inside(self) -> Column:
        c = F.col(self.column)
        out = c.isNotNull()
        out = out if self.low is None else out & (c > self.low)
        return out if self.high is None else out & (c < self.high)

    def proposal(self) -> Column:
        """Two values around the rank, from a quantile sketch."""
        middle, reach = (self.rank - self.before + 0.5) / self.held, 5 / _ACCURACY
        points = [max(middle - reach, 0.0), min(middle + reach, 1.0)]
        return F.percentile_approx(F.when(self.inside(), F.col(self.column)), points, _ACCURACY)

    def counts(self, a: float, b: float) -> Column:
        """How many of the values lie below ``a``, at ``a``, between, and at ``b``."""
        c, own = F.col(self.column), self.inside()
        return F.array(*(F.count_if(own & part) for part in (c < a, c == a, (c > a) & (c < b), (c == b) & (c > a))))

    def narrow(self, a: float, b: float, below: int, at_a: int, between: int, at_b: int) -> None:
        place = self.rank - self.before
        if place < below:
            self.high, self.held = a, below
        elif place < below + at_a:
            self.found = a
        elif place < below + at_a + between:
            self.low, self.high, self.before, self.held = a, b, self.before + below + at_a, between
        elif place < below + at_a + between + at_b:
            self.found = b
        else:
            self.low, self.before = b, self.before + below + at_a + between + at_b
            self.held -= below + at_a + between + at_b


def _values_at(data: DataFrame, searches: list[_Search], small: int) -> None:
    """End all searches together: a round narrows every open one by two aggregates over the rows, whatever their number.

    A sketch proposes two values around each rank, counting decides on which side of them it lies, and the search goes on
    strictly between them; frequent values are thereby settled by their count alone. A round leaves about a thousandth of
    the rows, so 10^12 rows need four; the last ``small`` values of each column are fetched, all columns in one job.
    """
    while wide := [s for s in searches if s.found is None and s.held > small]:
        proposed = data.agg(*(s.proposal().alias(str(i)) for i, s in enumerate(wide))).head()
        counted = data.agg(*(s.counts(*proposed[i]).alias(str(i)) for i, s in enumerate(wide))).head()
        for s, points, numbers in zip(wide, proposed, counted):
            s.narrow(*points, *numbers)
    left = [s for s in searches if s.found is None]
    if left:
        cells = F.array(*(F.struct(F.lit(i).alias("i"), F.when(s.inside(), F.col(s.column)).alias("v")) for i, s in enumerate(left)))
        values: list[list[float]] = [[] for _ in left]
        for row in data.select(F.inline(cells)).where(F.col("v").isNotNull()).collect():
            values[row["i"]].append(row["v"])
        for s, own in zip(left, values):
            s.found = sorted(own)[s.rank - s.before]


def exact_medians(df: DataFrame, columns: list[str], small: int = 10_000) -> dict[str, float | None]:
    """Exact medians (mean of the middle two) of numeric columns, all columns in the same passes.

    The columns are stored first, so the passes read them alone and do not repeat what made ``df``.
    """
    if not columns:
        return {}
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    data = stored(df.select(*(F.col(c).cast("double").alias(n) for c, n in names.items())), "medians")
    counts = data.agg(*(F.count(n).alias(n) for n in names.values())).head()
    searches = [_Search(n, (counts[n] - 1) // 2, counts[n]) for n in names.values() if counts[n]]
    _values_at(data, searches, small)
    medians: dict[str, float | None] = dict.fromkeys(columns)
    if searches:
        ends = data.agg(*(F.struct(F.count_if(F.col(s.column) <= s.found).alias("upto"),
                                   F.min(F.when(F.col(s.column) > s.found, F.col(s.column))).alias("following")).alias(s.column)
                          for s in searches)).head()
        own = {n: c for c, n in names.items()}
        for s in searches:
            upto, following = ends[s.column]
            medians[own[s.column]] = s.found if upto > counts[s.column] // 2 else (s.found + following) / 2
    return medians


def value_at_rank(data: DataFrame, column: str, rank: int, n: int, small: int = 10_000) -> float:
    """The value at a rank (from 0) among the ``n`` non-null values of a column."""
    search = _Search("v", rank, n)
    _values_at(data.select(F.col(column).cast("double").alias("v")), [search], small)
    return search.found
