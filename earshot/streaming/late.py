"""Late rows: what arrives behind the watermark is kept apart and counted instead of being dropped.

Windowed operators drop what lies behind their watermark without a trace. :func:`follow` runs in front of them. Each
batch is written in one pass, divided into rows in time and late ones; the same pass counts both and finds the latest time
(``DataFrame.observe``), which is stored beside the batch. The horizon of a batch is the latest time of all earlier
batches less the allowed delay, as Spark's own watermarks have it; what a window drops, since it has ended before the
watermark, is among the late rows. A batch that is run again finds the same horizon and overwrites its own folder, so each
row counts once.

    folder/rows/batch=N/is_late=false|true     the rows
    folder/arrivals/batch=N                    counts, horizon and latest time
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

# Times are stored in microseconds, which no time zone of a driver can shift.
_ARRIVALS = "batch bigint, in_time bigint, late bigint, untimed bigint, horizon bigint, latest bigint"


def _before(spark: SparkSession, folder: str, batch_id: int, delay: str) -> tuple[int | None, int | None]:
    """Latest time of all earlier batches, and the horizon that follows from it."""
    if batch_id == 0:
        return None, None
    earlier = spark.read.schema(_ARRIVALS).parquet(f"{folder}/arrivals").where(F.col("batch") < batch_id)
    horizon = F.unix_micros(F.timestamp_micros(F.max("latest")) - F.expr(f"interval {delay}"))
    return tuple(earlier.agg(F.max("latest"), horizon).head())


def take(batch: DataFrame, batch_id: int, folder: str, ts: str = "ts", delay: str = "1 hour") -> None:
    """Store one batch; for ``foreachBatch``. Rows without a time are in time: no window asks for them.

    Call it on a frame of a stream's own session, as ``foreachBatch`` hands it over, or of ``spark.newSession()``: in a
    session that has observed rows, fitted classifiers of ``spark.ml`` can no longer be sent to tasks.
    """
    spark = batch.sparkSession
    latest, horizon = _before(spark, folder, batch_id, delay)
    micros = F.unix_micros(F.col(ts))
    late = F.coalesce(micros < F.lit(horizon).cast("bigint"), F.lit(False))
    counted = Observation()
    marked = batch.withColumn("is_late", late).observe(
        counted, F.count_if(~F.col("is_late")).alias("in_time"), F.count_if("is_late").alias("late"),
        F.count_if(F.col(ts).isNull()).alias("untimed"), F.max(micros).alias("latest"))
    marked.write.mode("overwrite").partitionBy("is_late").parquet(f"{folder}/rows/batch={batch_id}")
    found = counted.get
    latest = max((t for t in (latest, found["latest"]) if t is not None), default=None)
    row = [(batch_id, found["in_time"], found["late"], found["untimed"], horizon, latest)]
    spark.createDataFrame(row, _ARRIVALS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/arrivals/part={batch_id}")


def follow(stream: DataFrame, folder: str, ts: str = "ts", delay: str = "1 hour") -> None:
    """Store all that is at hand; a later call goes on where this one ended."""
    query = (stream.writeStream.foreachBatch(lambda batch, n: take(batch, n, folder, ts, delay))
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def rows(spark: SparkSession, folder: str, schema: T.StructType, late: bool | None = None) -> DataFrame:
    """The stored rows of this schema with ``batch`` and ``is_late``; ``late`` picks one side."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("is_late", T.BooleanType())])
    found = spark.read.schema(whole).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return found if late is None else found.where(F.col("is_late") == late)


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Per batch: rows in time, late and without a time, the horizon that decided, and the latest time so far."""
    found = spark.read.schema(_ARRIVALS).parquet(f"{folder}/arrivals")
    return found.select("batch", "in_time", "late", "untimed",
                        *(F.timestamp_micros(c).alias(c) for c in ("horizon", "latest")))


def corrected_days(spark: SparkSession, folder: str, schema: T.StructType, ts: str = "ts") -> DataFrame:
    """Daily active users of the rows in time, and with the late ones: what a report shows first and what it is corrected to.

    Users are counted exactly: rows become one per day and user before they are counted.
    """
    per_user = (rows(spark, folder, schema).where(F.col(ts).isNotNull())
                .groupBy(F.to_date(ts).alias("date"), "user_id")
                .agg(F.count_if(~F.col("is_late")).alias("_first"), F.count("*").alias("_all")))
    known = F.col("user_id").isNotNull()
    return (per_user.groupBy("date").agg(
        F.count_if(known & (F.col("_first") > 0)).alias("dau_in_time"), F.count_if(known).alias("dau"),
        F.sum(F.col("_all") - F.col("_first")).alias("late_events"), F.sum("_all").alias("events")))
