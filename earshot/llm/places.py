"""Places of rows in a global order, and of groups in it, without a window over a whole table or group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.base import materialize

_IN_PART = 33  # bits of a row's number inside its partition, as monotonically_increasing_id counts


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, ``start`` and ``n``: the row's place from 0, its group's first place, the group's rows.

    Rows are ordered by ``group``, then ``order``, ascending, nulls first; a group is the rows of equal ``group`` columns,
    all rows if there are none. They are dealt into ranges and sorted inside, so a group of any size spreads over ranges,
    and written with their number inside the range: from there on a lost executor changes nothing. One row per range and
    group is left for the totals; what is joined back meets the rows by range and group, so no key holds more than a range.
    """
    by = [*group, *order]
    ranged = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                         .withColumn("_at", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("_part", F.shiftright("_at", _IN_PART))
    held = ranged.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    parts = held.groupBy("_part").agg(F.sum("_rows").alias("_all")).select(
        "_part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))

    def place(column: str):
        return F.col("_before") + F.col(column).bitwiseAND(F.lit((1 << _IN_PART) - 1))
    held = held.join(parts, "_part").withColumn("_first", place("_first"))
    if not group:
        n = held.agg(F.sum("_rows")).first()[0] or 0
        told = held.select("_part", "_before", F.lit(0).cast("long").alias("start"), F.lit(n).cast("long").alias("n"))
    else:
        totals = held.groupBy(*group).agg(F.min("_first").alias("start"), F.sum("_rows").alias("n"))
        told = held.alias("h").join(totals.alias("t"), _same("h", "t", group)).select(
            "h._part", *(F.col(f"h.{c}") for c in group), "h._before", "t.start", "t.n")
    return (ranged.alias("r").join(told.alias("t"), (F.col("r._part") == F.col("t._part")) & _same("r", "t", group))
            .select(*(F.col(f"r.`{c}`") for c in rows.columns), place("_at").alias("place"), "t.start", "t.n"))


def _same(left: str, right: str, columns: list[str]):
    """Equal columns of two aliased frames, null equal to null."""
    return reduce(and_, (F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns), F.lit(True))
