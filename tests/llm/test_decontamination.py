"""Contamination against a plain version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from earshot.llm import decontamination as dc


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, window=10):
    holders = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            holders.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = []
    for doc, text in rows:
        w = words_of(text)
        hit, found = set(), set()
        for i in range(len(w)):
            for size in {len(h) for h in holders}:
                part = tuple(w[i:i + size])
                if len(part) == size and part in holders:
                    hit.update(range(i, i + size))
                    found |= {str(x) for x in holders[part] if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def sample(seed):
    rng = random.Random(seed)
    vocabulary = "one two Three, four-five É ñandú 7 eight. nine TEN".split()
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 9, 10, 11, 30])))) for i in range(12)]
    items += [(None, "no id at all"), (40, items[3][1]), (41, None), (100, "the end")]
    rows = []
    for i in range(40):
        parts = [rng.choice([rng.choice(items)[1] or "", " ".join(rng.choices(vocabulary, k=15)), "x!", "THE... end"]) for _ in range(4)]
        rows.append((i, rng.choice([" ", "\n", " - "]).join(parts)))
    return rows + [(7, None), (8, ""), (None, "no id, at all"), rows[0]], items


KEY = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 300])
def test_against_plain(spark, docs, block_bytes, monkeypatch):
    rows, items = sample(block_bytes)
    monkeypatch.setattr(dc.find_contamination, "__defaults__", (10, block_bytes))
    frame = docs(rows).selectExpr("doc_id", "text", "1 as runs", "2 as items", "3 as doc")
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 as item")
    assert sorted(map(tuple, dc.contamination_report(frame, table).collect()), key=KEY) == sorted(plain(rows, items), key=KEY)


def test_spans_are_places_of_the_original(spark, docs):
    text = "É — before. ONE, two; three\nfour é five six seven eight nine TEN... after"
    items = spark.createDataFrame([(1, "one two three four é five six seven eight nine ten")], "item_id long, text string")
    row = dc.find_contamination(docs([(1, text)]), items).first()
    assert [text[a:z] for a, z in row.spans] == ["ONE, two; three\nfour é five six seven eight nine TEN"] and row.n_hit == 11


def test_contaminated_rows_go_and_columns_stay(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    frame = docs([(1, "x alpha beta y"), (2, "alpha x beta"), (3, None)]).selectExpr("doc_id", "text", "doc_id as n_hit")
    kept = dc.drop_contaminated(frame, items)
    assert kept.columns == ["doc_id", "text", "n_hit"] and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.drop_contaminated(frame, none).count() == 3 and dc.contamination_report(docs([]), items).collect() == []


def test_columns_that_cannot_be_null(spark, docs):
    schema = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("text", T.StringType(), False)])
    items = spark.createDataFrame([(1, "alpha beta"), (2, "beta x")], "item_id long, text string")
    frame = spark.createDataFrame([(1, "x alpha beta y"), (2, "alpha")], schema)
    for block_bytes in (1, dc.BLOCK_BYTES):
        got = {r.doc.doc_id: (r.n_hit, list(r["items"])) for r in dc.find_contamination(frame, items, block_bytes=block_bytes).collect()}
        assert got == {1: (2, ["1"]), 2: (0, [])}


def test_bytes_that_are_no_text(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    odd = docs([(1, "616c70686120ff20616c706861206265746120fe")]).selectExpr("doc_id", "cast(unhex(text) as string) as text")
    assert [(r.n_words, r.n_hit) for r in dc.contamination_report(odd, items).collect()] == [(5, 2)]
