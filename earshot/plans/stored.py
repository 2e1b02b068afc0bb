"""Intermediate tables in the shared folder, and places of rows in a global order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.session import shared_folder

_IN_PART = 33  # bits of a row's number inside its partition, as monotonically_increasing_id counts


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs neither repeat it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with its rows' ranks from 1 in a global order, without one task for all rows.

    Rows are dealt into ranges, sorted inside and written with their number there; one row per range is left to add up.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    ranged = ranged.withColumn("_part", F.shiftright("_at", _IN_PART))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    before = (ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
              .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _IN_PART) - 1))
    return (ranged.join(F.broadcast(before), "_part")  # as many rows as ranges
            .withColumn(rank, F.col("_before") + inside + 1).drop("_part", "_at", "_before"))
