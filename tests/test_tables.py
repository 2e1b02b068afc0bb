"""Sources, sinks, views, validation and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from earshot import DataLoader
from earshot.operators import quality as qu
from earshot.operators.engagement import user_metrics
from earshot.operators.sessionize import sessionize
from earshot.sources import readers, views, writers
from earshot.sources.mart import RAW_SCHEMAS
from earshot.streaming import live, sinks


@pytest.fixture
def people(rows):
    return rows([("a", "free", datetime(2024, 1, 1, 5)), ("b", "gold", datetime(2024, 1, 2)), ("b", None, None)],
                "user_id string, tier string, signup_date timestamp")


def test_csv_round_trip(spark, people, tmp_path):
    writers.export_reports({"users": people}, str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "users").glob("*.csv"))) == 1
    loader = DataLoader(spark)
    back = loader.load_csv(str(tmp_path / "out" / "users"), people.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, people.collect()), key=str)
    assert loader.load_csv(str(tmp_path / "out" / "users")).dtypes[2] == ("signup_date", "string")


def test_all_csv_files(spark, people, tmp_path):
    folder = tmp_path / "raw"
    writers.save_tables({"users.csv": people.select("user_id"), "other.csv": people.select("tier")}, str(folder), "csv")
    got = readers.load_all_csv(spark, str(folder), {"users": people.select("user_id").schema})
    assert sorted(got) == ["other", "users"] and got["users"].count() == 3
    assert readers.load_all_csv(spark, str(tmp_path / "nothing")) == {}


def test_parquet_reads_only_asked_columns(spark, people, tmp_path):
    writers.save_tables({"users": people}, str(tmp_path), partition_by={"users": ["tier"]})
    df = DataLoader(spark).load_parquet(str(tmp_path / "users"), ["user_id"])
    assert df.columns == ["user_id"] and "ReadSchema: struct<user_id:string>" in df._jdf.queryExecution().toString()


def test_queries_and_tables(spark, people):
    people.createOrReplaceTempView("some_users")
    loader = DataLoader(spark)
    assert loader.load_from_db("select * from some_users where user_id = :who", {"who": "a"}).count() == 1
    assert loader.load_table("some_users").count() == 3
    for call in (lambda d: d.load_from_db("select 1"), lambda d: d.load_table("t")):
        with pytest.raises(ConnectionError):
            call(DataLoader(spark, jdbc={}))


def test_results_as_json(spark, people, tmp_path):
    writers.save_results({"people": people}, str(tmp_path))
    lines = spark.read.text(str(tmp_path / "people")).collect()
    assert any('"signup_date":"2024-01-01T05:00:00.000Z"' in r[0] for r in lines) and any('"tier":null' in r[0] for r in lines)


def test_views(spark, mart):
    names = views.register_views({"users": mart.users, "sessions": mart.sessions}, datetime(2001, 1, 1))
    assert names == ["daily_active_users", "monthly_active_users", "sessions", "user_cohort_summary", "users"]
    assert spark.sql("select max(dau) from daily_active_users").head()[0] > 0


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", sorted(RAW_SCHEMAS))
def test_stated_schemas_are_those_of_the_files(spark, sf, name):
    found = spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet").dtypes
    assert found == spark.createDataFrame([], RAW_SCHEMAS[name]).dtypes


def test_validate(spark, rows, caplog):
    df = rows([("2024-01-01",)], "d string")
    assert qu.validate(df, ["d"], ["d", "absent"]).dtypes == [("d", "timestamp")]
    with pytest.raises(ValueError, match="lacks the columns"):
        DataLoader(spark).validate_data(df, ["d", "x"])
    assert qu.validate(rows([("no date",)], "d string"), ["d"], ["d"], lenient=True).head()[0] is None
    with pytest.raises(Exception):
        qu.validate(rows([("no date",)], "d string"), ["d"], ["d"]).collect()
    qu.validate(df.limit(0), ["d"])
    assert "no rows" in caplog.text


def test_rules(people, rows):
    found = {(r.rule, r.column_name): r.violations for r in qu.check_tables({
        "users": people, "ab_test_assignments": rows([("z", "t", "control"), (None, "t", "both")], "user_id string, test_name string, variant string")}).collect()}
    assert found[("domain", "tier")] == 1 and found[("not_null", "tier")] == 1 and found[("key", "user_id")] == 1
    assert found[("domain", "variant")] == 1 and found[("reference", "user_id")] == 1 and found[("not_null", "user_id")] == 1


# --- streams ----------------------------------------------------------------

def events(spark, tmp_path, *batches):
    """A stream that takes one file per batch, in order of their names."""
    for i, batch in enumerate(batches):
        df = spark.createDataFrame([(u, datetime.fromisoformat(t)) for u, t in batch], "user_id string, ts timestamp")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    schema = "user_id string, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b*"))


END = ("zz", "2024-02-01 00:00:00")  # moves the watermark past everything else


def test_stream_sessions_equal_batch(spark, tmp_path):
    data = [("u", "2024-01-01 10:00:00"), ("u", "2024-01-01 10:29:00"), ("u", "2024-01-01 12:00:00"), ("v", "2024-01-01 10:00:00")]
    stream = events(spark, tmp_path, data[:2], data[2:], [END])
    got = sinks.drain(live.sessions(stream), str(tmp_path / "out"))
    want = sessionize(spark.createDataFrame([(u, datetime.fromisoformat(t)) for u, t in data], "user_id string, ts timestamp"), "ts").drop("session_no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_late_events_are_dropped(spark, tmp_path):
    stream = events(spark, tmp_path, [("u", "2024-01-05 10:00:00")], [("v", "2024-01-05 09:30:00")],
                    [("late", "2024-01-03 10:00:00")], [END])
    got = {str(r.date): r.dau for r in sinks.drain(live.daily_active_users(stream), str(tmp_path / "out")).collect()}
    assert got == {"2024-01-05": 2}


def test_rolling_windows_overlap(spark, tmp_path):
    stream = events(spark, tmp_path, [("u", "2024-01-01 10:20:00"), ("v", "2024-01-01 10:50:00")], [END])
    got = sinks.drain(live.rolling_rate(stream, F.col("user_id") == "u"), str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r.window_start.strftime("%H:%M") for r in got] == ["09:30", "09:45", "10:00", "10:15", "10:30", "10:45"]
    assert [r.rate for r in got] == [1.0, 1.0, 0.5, 0.5, 0.0, 0.0]


def test_metrics_table_follows_and_repeats_safely(spark, plays, tmp_path):
    table = sinks.UserMetricsTable(spark, str(tmp_path / "metrics"))
    batches = [plays(("a", "2024-01-01 10:00"), ("b", "2024-01-01 10:00")),
               plays(("b", "2024-01-02 10:00", {"track_id": "t2"})), plays(("c", "2024-01-03 10:00"))]
    assert table.snapshot() is None
    for i, batch in enumerate(batches):
        table.apply(batch, i)
    table.apply(batches[2], 2)  # the same batch again, as after a failure
    everything = batches[0].unionByName(batches[1]).unionByName(batches[2])
    want = sorted(map(tuple, user_metrics(everything).collect()))
    early = table.snapshot().drop("updated_at")
    assert sorted(map(tuple, early.collect())) == want
    table.compact()
    table.compact()
    table.apply(batches[2], 2)  # and once more, after it was folded in
    assert sorted(map(tuple, table.snapshot().drop("updated_at").collect())) == want
    assert sorted(map(tuple, early.collect())) == want  # a frame from before the compaction stays valid
    assert table.remove_replaced() == 0 and table._complete("deltas") == [0, 1, 2]
    assert table.remove_replaced(min_age_hours=0) == 3
    assert table._complete("bases") == [2] and table._complete("deltas") == []
    assert sorted(map(tuple, table.snapshot().drop("updated_at").collect())) == want
    assert table.snapshot().where("updated_at is null").isEmpty()
    table.apply(plays(("a", "2024-01-04 10:00")), 3)
    assert {r.user_id: r.total_sessions for r in table.snapshot().collect()} == {"a": 2, "b": 2, "c": 1}
