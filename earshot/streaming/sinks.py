"""Running streams into tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from earshot.operators.engagement import merge_metric_parts, metric_parts, metrics_of_parts
from earshot.session import shared_folder


def stream_table(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Stream the files of a parquet table, a single file included.

    The last letter as a pattern lets one path name a file or a directory.
    """
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's output and checkpoint in the shared folder."""
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex[:12]}"


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Process what is there in append mode into ``folder`` and read the result.

    Append mode emits what the watermark has closed. What is open behind it, the
    last day or session included, waits for later events; for a table that is
    complete use the same function on a batch frame.
    """
    query = (stream.writeStream.outputMode("append").format("parquet")
             .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_complete(stream: DataFrame, folder: str) -> DataFrame:
    """Process what is there in complete mode; each batch replaces the result."""
    def replace(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    query = (stream.writeStream.outputMode("complete").foreachBatch(replace)
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


class UserMetricsTable:
    """The per-user metrics table, kept up to date by a stream of plays.

    A batch writes only its own sums per user and track, into a folder named
    after it; reading adds the sums up. A batch that runs again overwrites its
    folder, so every play counts once. :meth:`compact` folds finished batches
    into one base, from time to time, to keep reading cheap. It takes nothing
    away: frames read before stay valid until :meth:`remove_replaced`.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the completely written ``deltas`` or ``bases``, in one listing."""
        fs, marks = self._fs(f"{self.folder}/{kind}/*/_SUCCESS")
        names = [s.getPath().getParent().getName() for s in fs.globStatus(marks) or []]
        return sorted(int(n) for n in names if n.isdigit())

    def _current(self) -> tuple[int, list[str]]:
        """Last compacted batch (-1 if none) and the folders that make up the table."""
        bases = self._complete("bases")
        done = bases[-1] if bases else -1
        deltas = [f"{self.folder}/deltas/{n}" for n in self._complete("deltas") if n > done]
        return done, ([f"{self.folder}/bases/{done}"] if bases else []) + deltas

    def apply(self, plays: DataFrame, batch_id: int) -> None:
        """Take in one batch of plays; for ``foreachBatch``."""
        bases = self._complete("bases")
        if not bases or batch_id > bases[-1]:
            metric_parts(plays).write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch_id}")

    def _parts(self) -> DataFrame | None:
        folders = self._current()[1]
        if not folders:
            return None
        schema = self.spark.read.parquet(folders[0]).schema
        return merge_metric_parts(self.spark.read.schema(schema).parquet(*folders))

    def snapshot(self) -> DataFrame | None:
        """The table as of the last batch, with the time of reading as ``updated_at``; None before the first."""
        parts = self._parts()
        return None if parts is None else metrics_of_parts(parts).withColumn("updated_at", F.current_timestamp())

    def compact(self) -> None:
        """Fold all batches so far into a new base."""
        deltas = self._complete("deltas")
        if deltas and deltas[-1] > self._current()[0]:
            self._parts().write.mode("overwrite").parquet(f"{self.folder}/bases/{deltas[-1]}")

    def remove_replaced(self, min_age_hours: float = 24.0) -> int:
        """Delete folders that the current base replaced and that are older than any reader; returns how many."""
        done = self._current()[0]
        removed = 0
        for kind in ("deltas", "bases"):
            for n in self._complete(kind):
                fs, path = self._fs(f"{self.folder}/{kind}/{n}")
                age = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
                if (n < done or kind == "deltas" and n == done) and age >= min_age_hours * 3600:
                    removed += bool(fs.delete(path, True))
        return removed

    def follow(self, plays: DataFrame) -> DataFrame:
        """Process the plays at hand and return the table."""
        query = (plays.writeStream.foreachBatch(self.apply)
                 .option("checkpointLocation", f"{self.folder}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return self.snapshot()
