"""A layout of plays in which everything by user needs no shuffle.

Plays are stored in buckets by hash of the user, sorted inside. Read back, the table is partitioned by user as far as the
planner is concerned: aggregates, windows and joins with another table of as many buckets by user run where the rows lie.
The shuffle is paid once, when plays are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Least buckets of a table: as many tasks read it.
BUCKETS = 64

#: Rows that a bucket may hold on average before there are more buckets.
_ROWS = 500_000


def save_bucketed(df: DataFrame, name: str, path: str, key: str = "user_id", order: tuple[str, ...] = ("timestamp",),
                  buckets: int = BUCKETS) -> DataFrame:
    """Store ``df`` as the table ``name`` under ``path``, bucketed by ``key`` and sorted by it and ``order``; returns the table.

    Rows are dealt by the key first, so a bucket is one file. Tables of equal buckets and key join without a shuffle.
    ``buckets`` is the least number; it is doubled until none holds more than about :data:`_ROWS` rows, since one task writes
    and one reads a bucket. The rows are counted for it, so ``df`` should be stored if it is costly.
    """
    rows = df.count()
    while rows > buckets * _ROWS:
        buckets *= 2
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *order)
     .option("path", path).saveAsTable(name))
    return load_bucketed(df.sparkSession, name)


def load_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
