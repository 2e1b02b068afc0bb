"""A corpus pipeline over ``documents``: reject poor texts, drop repeated lines, keep one of near copies, drop leaked tests, tokenize.

Every stage works on all rows and whole texts that its predecessor kept, and all but the last return the columns of
``documents``. Rows with null or empty texts pass every stage but the first, which scores them like any other, and the
near-copy stage, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import base, bpe, decontamination, line_dedup, quality, simhash


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels that are not held out."""
    return quality.keep_good(docs, base.table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay only in the one of largest id."""
    base.prepare(spark)
    return base.restored(line_dedup.dedup_lines(docs), docs, text=F.col("kept"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one of smallest id stays: shingles of four words, at most four bits apart."""
    base.prepare(spark)
    return simhash.keep_first_of_group(docs, words_in=4, radius=4)


def drop_leaked_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, base.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left; decoded ids give the same bytes."""
    base.prepare(spark)
    return bpe.round_trip_report(docs)


STAGES = [
    ("quality", reject_poor),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_leaked_tests),
    ("byte_bpe", tokenize),
]

#: Classifier weights, fingerprints and merges of tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = base.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = base.materialize(docs, f"pipeline-{name}")
    return docs
