"""Keys that hold a share of all rows, and rows of the other keys dealt to tasks of bounded size."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Rows that a key may have at least, and the part of all rows that it may have, before it is heavy. The part bounds the
#: number of heavy keys.
_LEAST, _PART = 100_000, 1 / 2000

#: Rows that a task gets on average of rows dealt by key.
_TASK_ROWS = 100_000

_BUCKETS = 1 << 14


@dataclass(frozen=True)
class KeySizes:
    """How many rows there are, and which keys hold so many of them that one task should not have all rows of one."""

    rows: int
    heavy: tuple = ()

    def is_heavy(self, key: str) -> Column:
        some = F.col(key).isin([k for k in self.heavy if k is not None])
        return F.coalesce(some, F.lit(False)) | F.col(key).isNull() if None in self.heavy else F.coalesce(some, F.lit(False))


def key_sizes(df: DataFrame, key: str) -> KeySizes:
    """Exact, without a shuffle of all keys; ``df`` is read for it, so it should be stored if it is costly.

    Rows are counted per bucket of the keys' hash, inside the map tasks. Only in buckets with as many rows as a heavy key has
    are keys counted one by one. Null counts as a key.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int")
    counts = {r[0]: r[1] for r in df.groupBy(bucket).agg(F.count(F.lit(1))).collect()}  # at most _BUCKETS rows
    rows = sum(counts.values())
    most = max(_LEAST, int(rows * _PART))
    full = [b for b, n in counts.items() if n > most]
    if not full:
        return KeySizes(rows)
    sizes = df.where(bucket.isin(full)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return KeySizes(rows, tuple(r[0] for r in sizes.where(F.col("_n") > most).select(key).collect()))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, partitioned by ``key``: what follows by the key shuffles it no more.

    Few rows are left to AQE, which joins small partitions. Many go to more tasks than it would plan, since it splits none.
    """
    tasks = math.ceil(rows / _TASK_ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(tasks, key)
    return df.repartition(F.col(key))
