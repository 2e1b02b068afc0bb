"""Loading tables. Schemas are always given, never inferred."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from earshot import schemas

log = logging.getLogger(__name__)


def load_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             **options) -> DataFrame:
    """CSV with a header row. Without a schema every column is read as text."""
    reader = spark.read.option("header", True).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def load_all_csv(spark: SparkSession, directory: str,
                 table_schemas: dict[str, StructType] | None = None) -> dict[str, DataFrame]:
    """Every ``*.csv`` of a directory, keyed by file stem.

    Files named after a known table get its schema. A missing directory gives
    an empty dict and a warning. Works on any Hadoop file system.
    """
    known = {**schemas.TABLES, **(table_schemas or {})}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        log.warning("no such directory: %s", directory)
        return {}
    paths = sorted(str(s.getPath().toString()) for s in fs.listStatus(root)
                   if s.getPath().getName().endswith(".csv"))
    stems = {p.rsplit("/", 1)[-1][:-len(".csv")]: p for p in paths}
    return {stem: load_csv(spark, p, known.get(stem)) for stem, p in stems.items()}


def load_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet; with ``columns`` only those reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load_query(spark: SparkSession, query: str, params: dict | None = None,
               jdbc: dict | None = None) -> DataFrame:
    """A SQL query: on catalog tables and views, or pushed to a JDBC source.

    ``params`` are named parameters (``:name``) of a catalog query. ``jdbc``
    holds the options of the database (``url``, ``driver``, ...).
    """
    if jdbc is not None:
        if params:
            raise ValueError("bind the parameters of a JDBC query in its text")
        if "url" not in jdbc:
            raise ConnectionError("no database connection: option 'url' is missing")
        return spark.read.format("jdbc").options(**jdbc).option("query", query).load()
    return spark.sql(query, args=params or {})


def load_table(spark: SparkSession, name: str, jdbc: dict | None = None,
               split_column: str | None = None, bounds: tuple | None = None,
               splits: int = 64) -> DataFrame:
    """A whole table: from the catalog, or over JDBC in parallel range reads.

    ``split_column`` with its (low, high) ``bounds`` makes ``splits`` readers;
    without them a database table comes through one connection.
    """
    if jdbc is None:
        return spark.table(name)
    if "url" not in jdbc:
        raise ConnectionError("no database connection: option 'url' is missing")
    reader = spark.read.format("jdbc").options(**jdbc).option("dbtable", name)
    if split_column:
        low, high = bounds
        reader = reader.options(partitionColumn=split_column, lowerBound=str(low),
                                upperBound=str(high), numPartitions=str(splits))
    return reader.load()
