"""Saving tables and small results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_tables(tables: dict[str, DataFrame], directory: str, fmt: str = "parquet",
                partition_by: dict[str, list[str]] | None = None) -> None:
    """Write each table under ``directory/<name>``; CSV gets a header row.

    Rows of a partitioned table are brought together by partition value first,
    to write few files; AQE splits values that hold too many rows for a task.
    """
    for name, df in tables.items():
        columns = (partition_by or {}).get(name)
        writer = (df.hint("rebalance", *columns) if columns else df).write.mode("overwrite")
        if columns:
            writer = writer.partitionBy(*columns)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{directory}/{name}")


def export_reports(reports: dict[str, DataFrame], directory: str) -> None:
    """Each report as CSV. Small reports end in one part: a rebalance merges small partitions and splits large ones."""
    for name, df in reports.items():
        df.hint("rebalance").write.mode("overwrite").option("header", True).csv(f"{directory}/{name}")


def export_dashboard(dau_mau: DataFrame, skip_rates: dict[str, DataFrame],
                     retention: DataFrame, directory: str) -> None:
    """The five dashboard extracts: activity, three skip-rate cuts, retention."""
    export_reports({"dau_mau_metrics": dau_mau,
                    **{f"skip_rates_{name}": df for name, df in skip_rates.items()},
                    "retention_curve": retention}, directory)


def save_results(results: dict[str, DataFrame], directory: str) -> None:
    """Result frames as JSON lines; dates and timestamps become ISO text."""
    for name, df in results.items():
        df.hint("rebalance").write.mode("overwrite").option("ignoreNullFields", False) \
            .json(f"{directory}/{name}")
