"""The rule ensemble: rules of a tree, held-out accuracy, odd tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import quality as q
from earshot.llm.base import table

SF_DIR = "/root/testdata/sf0.01"


def test_rules_of_a_description():
    text = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 5.5)
     If (feature 1 <= 2.0E-4)
      Predict: 0.0
     Else (feature 1 > 2.0E-4)
      Predict: 1.0
    Else (feature 0 > 5.5)
     If (feature 0 <= 9.5)
      Predict: 1.0
     Else (feature 0 > 9.5)
      Predict: 0.0
  Tree 1 (weight 1.0):
    Predict: 0.0
"""
    a, b = q.STATS[0], q.STATS[1]
    assert q.tree_rules(text) == {
        ((a, True, 5.5),), ((a, False, 5.5),), tuple(sorted([(a, True, 5.5), (b, True, 2e-4)])), tuple(sorted([(a, True, 5.5), (b, False, 2e-4)])),
        tuple(sorted([(a, False, 5.5), (a, True, 9.5)])), ((a, False, 9.5),)}


def test_statistics():
    assert q.statistics(b"") == q.statistics(b" \n") == (0.0,) * len(q.STATS)
    found = dict(zip(q.STATS, q.statistics("ab ab ab! | #x\nAb ab".encode())))
    assert found["words"] == 7 and found["repeated_words"] == 1 / 7 and found["lines"] == 2 and found["bars"] == 1 / 7


@pytest.fixture(scope="module")
def report(spark):
    return q.quality_report(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")).toPandas()


def test_held_out_accuracy(spark, report):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality").toPandas()
    both = report.merge(labels, on="doc_id")
    assert (report.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in report.doc_id]).all()
    assert report.score.between(0, 1).all() and (report.predicted == (report.score >= 0.7)).all()
    test = both[both.held_out]
    good, poor = test[test.quality == 1].score.values, test[test.quality == 0].score.values
    assert len(poor) and np.mean(good[:, None] > poor[None, :]) > 0.9 and (good >= 0.7).mean() > 0.95


def test_scores_do_not_depend_on_other_columns(spark, report):
    docs = table(spark, SF_DIR, "documents").withColumns({"lang": F.lit("zz"), "source": F.lit("s"), "n_chars": F.lit(1), "words": F.lit(3)})
    again = q.quality_report(docs, table(spark, SF_DIR, "labels")).toPandas().set_index("doc_id").score
    assert np.allclose(again.sort_index().values, report.set_index("doc_id").score.sort_index().values)


def test_odd_tables(spark, docs):
    frame = docs([(1, "some text here"), (2, None), (2, None), (None, "")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.predicted for r in q.quality_report(frame, none).collect()} == {1}
    ones = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert {r.predicted for r in q.quality_report(frame, ones).collect()} == {0}
    assert q.quality_report(docs([]), none).collect() == []
    assert sorted(q.keep_good(frame, none).collect(), key=str) == sorted(frame.collect(), key=str)


def test_bounded_fit(spark):
    model = q.fit(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"), max_rows=150)
    assert model.rules and all(weight for _, weight in model.rules)


def test_score_is_that_of_the_rules(spark):
    """The compiled columns against rules that are evaluated one by one on plain statistics."""
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    model = q.fit(docs, labels)
    assert len(model.rules) > 5
    got = {r.doc.doc_id: r.score for r in q.scored(docs, model).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        stats = dict(zip(q.STATS, q.statistics((text or "").encode())))
        total = model.intercept
        for rule, weight in model.rules:
            if all(stats[name] <= bound if most else stats[name] > bound for name, most, bound in rule):
                total += weight
        assert got[doc_id] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
