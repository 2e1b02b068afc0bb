"""Exact picks, medians and running totals against brute force."""

import statistics

import pytest
from pyspark.sql import functions as F

from earshot.operators import preparation as pr
from earshot.plans import hashpick, ranks


@pytest.fixture
def users(spark):
    return spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("kind"))


def test_split_has_exact_sizes_and_no_overlap(users):
    train, test = pr.train_test_split(users, ["id"], 0.2)
    assert (train.count(), test.count()) == (800, 200)
    assert train.join(test, "id").count() == 0 and train.columns == users.columns


def test_split_rounds_up(spark):
    train, test = pr.train_test_split(spark.range(11), ["id"], 0.25)
    assert (train.count(), test.count()) == (8, 3)


def test_stratified_split(users):
    _, test = pr.train_test_split(users, ["id"], 0.25, stratify="kind")
    assert {r["kind"]: r["count"] for r in test.groupBy("kind").count().collect()} == {"rare": 25, "common": 225}


def test_stratified_split_keeps_null_stratum(users):
    df = users.withColumn("kind", F.when(F.col("kind") == "common", F.col("kind")))
    _, test = pr.train_test_split(df, ["id"], 0.25, stratify="kind")
    assert {r["kind"]: r["count"] for r in test.groupBy("kind").count().collect()} == {None: 25, "common": 225}


def test_quotas_use_largest_remainders(rows):
    df = rows([("a",)] * 3 + [("b",)] * 3 + [("c",)] * 1, "k string")
    got = {r.k: r.quota for r in hashpick.stratum_quotas(df, ["k"], F.lit(4)).collect()}
    assert got == {"a": 2, "b": 2, "c": 0}


def test_pick_is_independent_of_partitioning(users):
    a = {r.id for r in pr.sample(users, n=50, key=["id"]).collect()}
    b = {r.id for r in pr.sample(users.repartition(7, "kind"), n=50, key=["id"]).collect()}
    assert a == b and len(a) == 50
    assert a != {r.id for r in pr.sample(users, n=50, key=["id"], seed=1).collect()}


@pytest.mark.parametrize("n,want", [(0, 0), (1000, 1000), (5000, 1000), (1, 1)])
def test_sample_sizes(users, n, want):
    assert pr.sample(users, n=n, key=["id"]).count() == want


def test_pick_without_broadcast(users, monkeypatch):
    monkeypatch.setattr(hashpick, "MANY_STRATA", 1)
    _, test = pr.train_test_split(users, ["id"], 0.25, stratify="kind")
    assert test.count() == 250


def test_sizes_are_exact_where_rows_repeat(spark):
    """A third of the rows are equal; copies are picked one by one and spread over the pick."""
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    for n in (1, 10, 200, 450, 899, 900, 2000):
        assert pr.sample(df, n=n).count() == min(n, 900)
    assert 100 < pr.sample(df, n=450, key=["k"]).where("k = -1").count() < 200
    train, test = pr.train_test_split(spark.range(1000).selectExpr("id % 3 as v"), ["v"], 0.2)
    assert (train.count(), test.count()) == (800, 200)
    kept = spark.range(1000).selectExpr("id % 3 as v", "id % 2 as s")
    marked = pr.mark_split(kept, ["v"], 0.2, stratify="s").groupBy("s", "is_test").count().collect()
    assert sorted((r.s, r["is_test"], r["count"]) for r in marked) == [(0, False, 400), (0, True, 100), (1, False, 400), (1, True, 100)]


def test_keys_of_several_columns_are_told_apart(rows):
    df = rows([("a:b", "c"), ("a", "b:c"), (None, "c"), ("c", None)], "x string, y string")
    assert df.select(hashpick.row_hash(["x", "y"], 1)).distinct().count() == 4


def test_sample_fraction_and_all(users):
    assert 60 < pr.sample(users, frac=0.1).count() < 140
    assert pr.sample(users).count() == 1000


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 40 + [1.0, 9.0], list(range(101)), list(range(100)),
    [1.0] * 50 + [2.0] * 50, [1e-300, 1e300, 0.0, -1e300], [float(i * i % 97) for i in range(500)],
    [7.0] * 400 + [float(i) for i in range(401)],
])
def test_medians(rows, values):
    df = rows([(float(v),) for v in values] + [(None,)], "x double")
    for small in (1, 5, 10_000):
        assert ranks.exact_medians(df, ["x"], small)["x"] == statistics.median(values)


def test_every_rank(rows):
    values = sorted([4.0] * 30 + [float(i % 13) for i in range(60)])
    df = rows([(v,) for v in values], "x double")
    for rank in (0, 1, 29, 45, 60, 88, 89):
        assert ranks.value_at_rank(df, "x", rank, len(values), small=2) == values[rank]


def test_median_of_nothing(rows):
    assert ranks.exact_medians(rows([(None,)], "x double"), ["x"]) == {"x": None}
    assert ranks.exact_medians(rows([(None,)], "x double"), []) == {}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [2, 5, 512])
def test_running_totals(rows, descending, buckets):
    data = [(float((i * 37) % 101), i % 4) for i in range(101)]
    got = ranks.running_totals(rows(data, "x double, n int"), "x", ["n"], descending, buckets)
    total, want = 0, {}
    for x, n in sorted(data, reverse=descending):
        want[x] = total
        total += n
    assert {r.x: r.n_before for r in got.collect()} == want


def test_missing_values(rows):
    df = rows([(1.0, 1, "b"), (None, None, "a"), (4.0, 3, None), (4.0, 4, "b"), (None, 9, "a")], "x double, n int, s string")
    def column(strategy, c, **kw):
        return [r[c] for r in pr.handle_missing(df, strategy, **kw).collect()]
    assert column("mean", "x") == [1.0, 3.0, 4.0, 4.0, 3.0]
    assert column("median", "x") == [1.0, 4.0, 4.0, 4.0, 4.0]
    assert column("median", "n") == [1, 3.5, 3, 4, 9]
    assert column("mode", "s") == ["b", "a", "a", "b", "a"]  # a tie: the smaller
    assert column("mode", "x") == [1.0, 4.0, 4.0, 4.0, 4.0]
    assert column("fill", "n", fill_value=0, columns=["n"]) == [1, 0, 3, 4, 9]
    assert len(column("drop", "x")) == 2 and len(column("drop", "x", columns=["s"])) == 4
    with pytest.raises(ValueError):
        pr.handle_missing(df, "guess")
    with pytest.raises(ValueError):
        pr.handle_missing(df, "fill")
    empty = rows([(None,)], "x double")
    assert pr.handle_missing(empty, "mode").head()[0] is None


def test_scaling_a_constant(rows):
    df = rows([(2.0, 1.0), (2.0, 3.0)], "c double, x double")
    assert [tuple(r) for r in pr.standardize(df, ["c", "x"]).collect()] == [(0.0, -1.0), (0.0, 1.0)]
    assert [tuple(r) for r in pr.min_max(df, ["c", "x"]).collect()] == [(0.0, 0.0), (0.0, 1.0)]
