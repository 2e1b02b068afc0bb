"""The pipeline's stages against plain versions, each on its predecessor's rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from earshot.llm import bpe, quality
from earshot.llm.base import prepare, table

from tests.llm.test_decontamination import plain as plain_contamination
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import plain_components, plain_print

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents, then the rows after each stage, written and read between."""
    docs = table(spark, SF_DIR, "documents")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, found[-1], SF_DIR).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    assert all(df.columns == COLUMNS for df in steps[:5])


def test_quality_stage(spark, steps):
    docs, kept = steps[:2]
    labels = table(spark, SF_DIR, "labels")
    want = quality.quality_report(docs, labels).filter("predicted = 1").select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())
    lost = docs.join(kept, "doc_id", "left_anti").join(labels, "doc_id").groupBy().agg(F.avg("quality")).first()[0]
    assert lost < 0.2  # what goes is poor


def test_line_stage(steps):
    before, after = pairs(steps[1]), dict(pairs(steps[2]))
    for doc, _, _, digest in plain_lines(before):
        assert hashlib.sha256(after[doc].encode()).hexdigest() == digest
    assert len(after) == len(before)


def test_near_copy_stage(steps):
    before, after = sorted(pairs(steps[2])), pairs(steps[3])
    groups = plain_components([plain_print(t) for _, t in before])
    assert sorted(i for i, _ in after) == sorted({before[g][0] for g in groups})


def test_decontamination_stage(spark, steps):
    before, after = pairs(steps[3]), pairs(steps[4])
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    assert sorted(i for i, _ in after) == sorted(r[0] for r in plain_contamination(before, items) if not r[5])
    assert len(after) < len(before)


def test_token_stage(steps):
    encoding, _ = bpe.load(bpe.default_rank_file())
    texts = dict(pairs(steps[4]))
    rows = steps[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.n_tokens == len(encoding.encode_ordinary(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[5].collect()))


def test_odd_rows_pass(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "plain words here", "z"), (1, None, "x")], "doc_id long, text string, keys string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == ["doc_id", "text", "keys"]
    assert sorted(map(tuple, docs.collect()), key=str) == sorted([(1, "", "x"), (None, "plain words here", "z")], key=str)
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
    assert empty.count() == 0
