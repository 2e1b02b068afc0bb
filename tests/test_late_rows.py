"""Late rows are kept and counted, also when a batch runs again."""

from pyspark.sql import functions as F

from earshot.streaming import late, live

SCHEMA = "event_id long, user_id long, ts timestamp"


def feed(spark, folder, *texts):
    """One file of events; each text is ``id user 'time'``."""
    rows = [(int(a), int(b), t) for a, b, t in (x.split(" ", 2) for x in texts)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string").select("event_id", "user_id", F.try_to_timestamp("t").alias("ts"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/inbox")
    late.follow(spark.readStream.schema(SCHEMA).parquet(f"{folder}/inbox"), folder)
    return df


def test_late_and_kept_are_all(spark, tmp_path):
    folder = str(tmp_path)
    first = feed(spark, folder, "1 1 2024-01-01 10:00", "2 1 2024-01-01 12:00")
    feed(spark, folder, "3 1 2024-01-01 11:00", "4 2 2024-01-01 10:59", "5 2 2024-01-02 09:00", "6 3 x")
    feed(spark, folder, "7 1 2024-01-02 08:00", "8 1 2024-01-02 07:59")
    got = {r.event_id: (r.batch, r.is_late) for r in late.rows(spark, folder, first.schema).collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (1, False), 4: (1, True), 5: (1, False), 6: (1, False), 7: (2, False), 8: (2, True)}
    counts = {r.batch: (r.in_time, r.late, r.untimed) for r in late.arrivals(spark, folder).collect()}
    assert counts == {0: (2, 0, 0), 1: (3, 1, 1), 2: (1, 1, 0)}
    assert late.rows(spark, folder, first.schema, late=True).count() == 2
    days = {str(r.date): (r.dau_in_time, r.dau, r.late_events, r.events) for r in late.corrected_days(spark, folder, first.schema).collect()}
    assert days == {"2024-01-01": (1, 2, 1, 4), "2024-01-02": (2, 2, 1, 3)}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    folder = str(tmp_path)
    df = feed(spark, folder, "1 1 2024-01-01 10:00")
    again = spark.newSession().createDataFrame([(2, 1, "2024-01-01 08:00"), (3, 1, "2024-01-01 12:00")], "event_id long, user_id long, t string").select(
        "event_id", "user_id", F.try_to_timestamp("t").alias("ts"))
    for _ in range(2):
        late.take(again, 1, folder)
    assert [(r.batch, r.in_time, r.late) for r in late.arrivals(spark, folder).orderBy("batch").collect()] == [(0, 1, 0), (1, 1, 1)]
    assert late.rows(spark, folder, df.schema).count() == 3


def test_what_windows_drop_is_among_the_late_rows(spark, tmp_path):
    """Spark's own windows, fed the same files, count all rows in time, and no more than all rows."""
    folder = str(tmp_path)
    for k in range(4, 9):
        df = feed(spark, folder, *(f"{10 * k + i} {i} 2024-01-{1 + k - (3 if i == 4 else 0):02d} 0{i}:30" for i in range(5)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/inbox")
    query = (live.daily_active_users(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/dau")
             .option("checkpointLocation", f"{folder}/dau-checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    closed = {str(r.date): r.events for r in spark.read.parquet(f"{folder}/dau").collect()}
    whole = {str(r.date): (r.events - r.late_events, r.events) for r in late.corrected_days(spark, folder, df.schema).collect()}
    assert closed and all(whole[d][0] <= n <= whole[d][1] for d, n in closed.items())
    assert sum(n for _, n in whole.values()) == 25
