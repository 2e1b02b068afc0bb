"""Pick an exact number of rows by hash, without sorting or shuffling the rows.

A row's position is the md5 of a seed and its key, so the choice depends on
neither partitioning nor task order, and a re-run task repeats it. Rows are
counted per hash prefix; the prefix in which the quota is reached is the only
one looked at hash by hash. What comes out is one limit hash per stratum, and
the pick itself is a filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from earshot.plans.stored import stored, with_rank

#: Hex digits of a prefix: as many as leave some thousand rows to one prefix.
_ROWS_OF_PREFIX = 4096

#: Up to here the per-stratum limits are broadcast, beyond they are joined by shuffle. The rows are the same.
MANY_STRATA = 10_000

#: Copies of one value that are numbered in one row at a time.
_CHUNK = 10_000

#: Numbered copies that a task makes.
_ROWS_OF_TASK = 1_000_000


def row_hash(key: list[str], seed: int) -> Column:
    """md5 of ``seed:key``, the order in which rows are picked.

    Several columns are told apart by their lengths, and null from every text.
    """
    if len(key) == 1:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key[0]).cast("string")))
    parts = [F.coalesce(F.concat_ws(":", F.length(F.col(c).cast("string")).cast("string"), F.col(c).cast("string")), F.lit("-"))
             for c in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def mark_picked(df: DataFrame, key: list[str], quotas: DataFrame, seed: int = 42,
                strata: list[str] = (), flag: str = "picked") -> DataFrame:
    """``df`` with a boolean ``flag`` true on the first ``quota`` rows by hash.

    ``quotas`` has the strata columns and ``quota``, one row per stratum.

    Where rows share the key, and only there, whole rows are hashed instead, and equal rows, which are interchangeable, are
    counted: every copy gets a hash of its own, so they are picked one by one and spread over the pick, and the counts
    become rows again. All other rows keep the hash of their key, so a repeated key somewhere re-deals nothing else. Rows
    with a repeated key must consist of columns that can be grouped (no maps).
    """
    hashed = df.select(*strata, row_hash(key, seed).alias("_hash"))
    sizes = hashed.groupBy("_hash").agg(F.count("*").alias("_n"))
    rows, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.max("_n")).head()
    own = df.withColumn("_hash", row_hash(key, seed))
    if (most or 0) <= 1:
        return _picked(own, rows, quotas, strata, flag)
    whole = list(df.columns)
    repeated = stored(sizes.where("_n > 1").select("_hash"), "repeated-keys")
    values = own.join(repeated, "_hash", "left_semi").groupBy(*whole).agg(F.count("*").alias("_copies"))
    # A few values may have all the copies: their chunks are dealt to as many tasks as the rows need, whatever file they lie in.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // _ROWS_OF_TASK))
    copies = (stored(values, "repeated-rows")
              .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / _CHUNK))))
              .repartition(tasks, *whole, "_chunk")
              .withColumn("_copy", F.explode(F.sequence(F.col("_chunk") * _CHUNK + 1,
                                                        F.least("_copies", (F.col("_chunk") + 1) * _CHUNK)))))
    copies = copies.withColumn("_hash", row_hash([*whole, "_copy"], seed)).select(*whole, "_hash")
    single = own.join(repeated, "_hash", "left_anti").select(*whole, "_hash")
    return _picked(single.unionByName(copies), rows, quotas, strata, flag)


def _picked(rows, n, quotas, strata, flag):
    """``rows``, which have their ``_hash``, marked by the quotas; ``n`` is their number."""
    prefix = max(4, math.ceil(math.log(max(n / _ROWS_OF_PREFIX, 1), 16)))
    if not strata:
        return _mark(rows.withColumn("_all", F.lit(1)), quotas.withColumn("_all", F.lit(1)), ["_all"], flag, F.broadcast, prefix).drop("_all")
    few = quotas.limit(MANY_STRATA + 1).count() <= MANY_STRATA
    return _mark(rows, quotas, list(strata), flag, F.broadcast if few else lambda d: d, prefix)


def _mark(rows, quotas, strata, flag, side, prefix):
    """``side`` wraps the frames of one row per stratum that rows are joined to; ``prefix`` is the length of hash prefixes."""
    def renamed(frame, *others):
        return frame.select(*(F.col(c).alias(f"_of_{c}") for c in strata), *others)

    def same_stratum():
        condition = F.lit(True)
        for c in strata:
            condition = condition & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        return condition

    of = [f"_of_{c}" for c in strata]
    hashes = rows.select(*strata, "_hash", F.substring("_hash", 1, prefix).alias("_prefix"))
    upto = Window.partitionBy(*strata).orderBy("_prefix")
    counted = (hashes.groupBy(*strata, "_prefix").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.sum("_n").over(upto) - F.col("_n")))
    edge = (counted.join(side(renamed(quotas, "quota")), same_stratum())
            .where((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("_n"))))
    edge = renamed(edge, F.col("_prefix").alias("_edge"), (F.col("quota") - F.col("_before")).alias("_left"))
    limits = (hashes.join(side(edge), same_stratum() & (F.col("_prefix") == F.col("_edge")))
              .groupBy(*strata, "_hash", "_left").agg(F.count("*").alias("_n"))
              .withColumn("_upto", F.sum("_n").over(Window.partitionBy(*strata).orderBy("_hash")))
              .where((F.col("_upto") - F.col("_n") < F.col("_left")) & (F.col("_left") <= F.col("_upto"))))
    limits = renamed(limits, F.col("_hash").alias("_limit"))
    return (rows.join(side(limits), same_stratum(), "left")
            .withColumn(flag, F.coalesce(F.col("_hash") <= F.col("_limit"), F.lit(False)))
            .drop("_hash", "_limit", *of))


def stratum_quotas(df: DataFrame, strata: list[str], wanted: Column) -> DataFrame:
    """Rows wanted of each stratum, summing exactly to ``wanted``.

    ``wanted`` is a column over ``total``, the number of rows. Each stratum gets its share rounded down; what remains goes
    to the largest remainders, on a tie to the first strata. Shares are whole numbers and exact. Up to :data:`MANY_STRATA`
    strata, one row each, are dealt on the driver; more are ranked by ranges. The quotas are the same.
    """
    spark = df.sparkSession
    sizes = df.groupBy(*strata).agg(F.count("*").alias("size"))
    first = sizes.limit(MANY_STRATA + 1).collect()
    if len(first) <= MANY_STRATA:
        return _few_quotas(spark, sizes.schema, first, strata, wanted)
    sizes = stored(sizes, "strata")
    total = sizes.agg(F.sum("size")).head()[0]
    aim = _evaluated(spark, total, wanted)
    share = F.col("size").cast("decimal(38,0)") * F.lit(aim).cast("decimal(19,0)")
    shared = sizes.withColumns({"base": F.expr(f"cast(cast(size as decimal(19,0)) * {aim}L div {total}L as bigint)"),
                                "rest": (share.cast("decimal(38,0)") % F.lit(total).cast("decimal(19,0)")).cast("decimal(19,0)")})
    spare = aim - shared.agg(F.sum("base")).head()[0]
    ranked = with_rank(shared, [F.desc("rest"), *(F.asc(c) for c in strata)])
    return ranked.select(*strata, (F.col("base") + F.when(F.col("rank") <= spare, 1).otherwise(0)).alias("quota"))


def _evaluated(spark, total: int, wanted: Column) -> int:
    return int(spark.createDataFrame([(total,)], "total bigint").select(wanted.cast("bigint")).head()[0] or 0)


def _few_quotas(spark, schema, rows, strata, wanted) -> DataFrame:
    """The quotas of a bounded number of strata."""
    total = sum(r["size"] for r in rows)
    aim = _evaluated(spark, total, wanted)
    order = sorted(rows, key=lambda r: (-(r["size"] * aim % total), [(r[c] is not None, r[c]) if r[c] is not None else (False, 0) for c in strata]))
    spare = aim - sum(r["size"] * aim // total for r in rows)
    quotas = [(*(r[c] for c in strata), r["size"] * aim // total + (k < spare)) for k, r in enumerate(order)]
    fields = [schema[c] for c in strata] + [T.StructField("quota", T.LongType())]
    return spark.createDataFrame(quotas, T.StructType(fields))
