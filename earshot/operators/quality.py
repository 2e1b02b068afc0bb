"""Validation: columns, types, domains, keys, references, completeness."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earshot import schemas

log = logging.getLogger(__name__)


def validate(df: DataFrame, required: list[str], date_columns: list[str] | None = None,
             lenient: bool = False) -> DataFrame:
    """Check that the columns exist and turn the date columns into timestamps.

    Missing columns raise ``ValueError``, an empty frame only warns. Text that
    is no date fails the job when it runs; with ``lenient`` it becomes null.
    """
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"the frame lacks the columns {missing}")
    parse = F.try_to_timestamp if lenient else F.to_timestamp
    for name in date_columns or []:
        if name in df.columns:
            df = df.withColumn(name, parse(F.col(name)))
    if df.isEmpty():
        log.warning("the frame has no rows")
    return df


def _counts_as_rows(df: DataFrame, counts: dict[str, Column], label: str) -> DataFrame:
    """Several counts in one pass, one row each."""
    row = df.agg(*(c.alias(name) for name, c in counts.items()))
    return row.select(F.inline(F.array(*(
        F.struct(F.lit(name).alias(label), F.col(f"`{name}`").alias("violations"))
        for name in counts))))


def domain_violations(df: DataFrame, table: str | None = None,
                      allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows per checked column whose value is not allowed; null is allowed."""
    allowed = allowed or schemas.DOMAINS[table]
    return _counts_as_rows(df, {c: F.count_if(~F.col(c).isin(v)) for c, v in allowed.items()}, "column_name")


def null_violations(df: DataFrame, table: str | None = None,
                    columns: list[str] | None = None) -> DataFrame:
    """Nulls per column that must not have any."""
    columns = columns or [c for c in schemas.not_null_columns(table) if c in df.columns]
    return _counts_as_rows(df, {c: F.count_if(F.col(c).isNull()) for c in columns}, "column_name")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where(F.col("occurrences") > 1)


def reference_violations(child: DataFrame, column: str, parent: DataFrame,
                         parent_column: str | None = None) -> DataFrame:
    """Non-null child values without a parent, with their number of rows."""
    values = (child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
              .agg(F.count("*").alias("row_count")))
    known = parent.select(F.col(parent_column or column).alias("value"))
    return values.join(known, "value", "left_anti")


def check_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All rules that apply to the given tables: rule, table, column, violations.

    Domains and missing values of a table are counted in one pass.
    """
    found = []
    for name, df in tables.items():
        allowed = {c: v for c, v in schemas.DOMAINS.get(name, {}).items() if c in df.columns}
        needed = [c for c in schemas.not_null_columns(name) if c in df.columns] if name in schemas.TABLES else []
        counts = {**{("domain", c): F.count_if(~F.col(c).isin(v)) for c, v in allowed.items()},
                  **{("not_null", c): F.count_if(F.col(c).isNull()) for c in needed}}
        if name in schemas.KEYS:
            keys = schemas.KEYS[name]
            twice = key_violations(df, keys).agg(F.count("*")).scalar()
            counts["key", ",".join(keys)] = twice
        if counts:
            aggregates = {k: c for k, c in counts.items() if k[0] != "key"}
            row = df.agg(*(c.alias(f"{rule} {column}") for (rule, column), c in aggregates.items()))
            found.append(row.select(F.inline(F.array(*(
                F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("table_name"),
                         F.lit(column).alias("column_name"),
                         (c if rule == "key" else F.col(f"`{rule} {column}`")).alias("violations"))
                for (rule, column), c in counts.items())))))
    for child, column, parent, parent_column in schemas.REFERENCES:
        if child in tables and parent in tables:
            missing = reference_violations(tables[child], column, tables[parent], parent_column)
            found.append(missing.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("violations")).select(
                F.lit("reference").alias("rule"), F.lit(child).alias("table_name"),
                F.lit(column).alias("column_name"), "violations"))
    if not found:
        return SparkSession.active().createDataFrame([], "rule string, table_name string, column_name string, violations bigint")
    result = found[0]
    for frame in found[1:]:
        result = result.unionByName(frame)
    return result
