"""The checked queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earshot.llm import (bpe, chat, decontamination, licenses, line_dedup, merkle, minhash, pii, quality, ranked_search, sharding, simhash,
                         suffix_dedup)
from earshot.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words inside benchmark windows."""
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that earlier documents hold."""
    return suffix_dedup.substring_dedup_report(table(spark, sf_dir, "documents"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return licenses.license_report(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes they decode to."""
    return bpe.round_trip_report(table(spark, sf_dir, "documents"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted for training, with digests of what is read back."""
    return chat.chat_report(table(spark, sf_dir, "conversations"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups of near ones."""
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.personal_data_report(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three documents share."""
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of edited texts, and their likeness."""
    return minhash.fingerprint_report(table(spark, sf_dir, "documents"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_search.search_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and inclusion proofs of all documents, some of them tampered with."""
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of equally many documents that keep equal texts together."""
    return sharding.sharding_report(table(spark, sf_dir, "documents"))


ORACLE["op1_decontamination"] = decontamination.ORACLE_SQL
ORACLE["op6_chat"] = chat.ORACLE_SQL
ORACLE["op9_line_dedup"] = line_dedup.ORACLE_SQL
ORACLE["op11_ranked_search"] = ranked_search.ORACLE_SQL
ORACLE["op12_merkle"] = merkle.ORACLE_SQL
