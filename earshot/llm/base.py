"""What the text operators share: session settings, tables, bytes of texts, intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.session import configure, shared_folder

#: A batch handed to Python holds at most so many bytes, so long texts cannot pile up in a worker.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}

#: A null id counts as the smallest of all.
NULL_ID = -(1 << 63)

#: A-Z in lower case and all that is no word byte as blanks; bytes of characters beyond ASCII are word bytes.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the library's SQL settings and the bounded Arrow batches."""
    configure(spark)
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/earshot-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later jobs neither repeat it nor lose it with an executor."""
    spark = df.sparkSession
    path = path or stored_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`materialize` that a later step has replaced."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Steps:
    """The tables of a loop: each step is written, and the one before the last removed, as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(stored_path(self.spark, self.name))
        out = materialize(df, self.name, self.paths[-1])
        if len(self.paths) > 1:
            remove(self.spark, self.paths[-2])
        return out


def keyed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """(id, text, ...): id as a long, null ids as :data:`NULL_ID`; null texts stay null."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("text").cast("string").alias("text"),
                       *more)


def carried(docs: DataFrame) -> DataFrame:
    """(doc, text): each row as a struct, so that no column name can clash, and its text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text").cast("string").alias("text"))


def restored(found: DataFrame, docs: DataFrame, **replaced) -> DataFrame:
    """The columns of ``docs`` out of ``found.doc``, some of them replaced."""
    return found.select(*(replaced[c].alias(c) if c in replaced else F.col(f"doc.`{c}`") for c in docs.columns))


def given_id(column: str = "id"):
    """The id as it came: :data:`NULL_ID` is null again."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias("doc_id")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of a string column; null is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        if len(chunk) == 0:
            continue
        kind = np.int64 if pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type) else np.int32
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, dtype=kind)[chunk.offset:chunk.offset + len(chunk) + 1].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        valid = chunk.is_valid().to_pylist() if chunk.null_count else None
        for i in range(len(chunk)):
            yield bytes(view[ends[i]:ends[i + 1]]) if valid is None or valid[i] else b""


def text_strings(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """Each text of a string column; null is empty. Bytes that are no UTF-8 become U+FFFD, as Python's decoder deals them out."""
    for text in text_bytes(column):
        yield text.decode("utf-8", "replace")


def string_array(texts: list[bytes]) -> pa.Array:
    """A string column of these bytes, whatever they hold."""
    return pa.array(texts, type=pa.binary()).view(pa.string())


def word_bytes(text: bytes) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


def char_offsets(text: bytes, positions: np.ndarray) -> np.ndarray:
    """Code-point offsets of byte positions in UTF-8 text."""
    if text.isascii():
        return positions
    lead = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])[positions]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the named columns in the schema's order."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema)
