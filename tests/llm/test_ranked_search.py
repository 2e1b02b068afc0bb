"""Ranked search against plain scoring, and what the best positions save."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from earshot.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    counts = [Counter(terms(t)) for _, t in docs]
    held = Counter(t for c in counts for t in c)
    n, total = sum(1 for c in counts if c), sum(c.total() for c in counts)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c in zip(docs, counts):
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * c.total() * n // total)))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_texts(rng, n, vocabulary=60):
    words = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(vocabulary)], k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_against_plain(spark, docs, monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(rs, "BLOCK_POSTINGS", block)
    texts = random_texts(rng, 300)
    texts += rng.choices(texts, k=80) + [texts[0]] * 40  # copies tie
    rows = [(i, t) for i, t in enumerate(texts)]
    items = list(enumerate(random_texts(rng, 12)))
    d, q = frames(spark, rows, items)
    assert found(rs.search_report(d, q)) == sorted(plain(rows, items), key=str)
    # Items in blocks of their own give the same.
    own = rs.best_documents(d, q, block_bytes=1).select("item_id", "rank", "id", "score")
    assert found(own) == sorted(plain(rows, items), key=str)


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, " .,-@[`{\x7f"), (4, "One TWO three"), (4, "One TWO three"), (None, "one é"), (5, "é " * 30_000 + "two"),
            (6, "Éa one_two 3d"), (-7, "one")]
    items = [(1, "one two"), (1, "one two"), (2, None), (3, "É 3D é"), (None, "three"), (5, "absent"), (6, "one " * 5000)]
    d, q = frames(spark, rows, items)
    d = d.selectExpr("doc_id", "text", "1 as id", "2 as n", "3 as item", "4 as rank", "5 as score")
    q = q.selectExpr("item_id", "text", "1 as item", "2 as id")
    assert found(rs.search_report(d, q)) == sorted(plain(rows, items), key=str)


def test_empty_tables(spark, docs):
    d, q = frames(spark, [(1, "one")], [(1, "one")])
    none_d, none_q = frames(spark, [], [])
    assert found(rs.search_report(none_d, q)) == []
    assert found(rs.search_report(d, none_q)) == []
    assert rs.search_report(d, none_q).columns == ["item_id", "rank", "doc_id", "score"]


def block_of(rng, n, k):
    """A block of ``n`` documents over ``k`` terms."""
    sizes = rng.integers(1, k, n)
    own = [np.sort(rng.choice(k, s, replace=False)) for s in sizes]
    counts = rng.geometric(0.4, sizes.sum())
    return rs.Block(rng.permutation(n) - n // 2, sizes * 3, sizes, np.concatenate(own), counts, rng.integers(0, 4000, k), n, int(sizes.sum()) * 3)


@pytest.mark.parametrize("seed", range(30))
def test_search_of_a_block(seed):
    rng = np.random.default_rng(seed)
    block = block_of(rng, 400, 12)
    wanted = np.sort(rng.choice(12, rng.integers(1, 6), replace=False))
    best = rs.Best(10)
    rs.search(block, wanted, best)
    scores = block.direct(np.arange(400), wanted)[0]
    order = np.lexsort((block.ids, -scores))[:10]
    order = order[scores[order] > 0]
    assert best.ids.tolist() == block.ids[order].tolist() and best.scores.tolist() == scores[order].tolist()


def test_best_positions_stop_early():
    # Two lists whose tops hold the same documents: direct accesses mark both, and a few places decide.
    n = 5000
    counts = np.repeat(np.arange(n, 0, -1), 2)
    block = rs.Block(np.arange(n), np.full(n, 10), np.full(n, 2), np.tile([0, 1], n), counts, np.array([1000, 900]), n, 10 * n)
    best = rs.Best(10)
    assert rs.search(block, np.array([0, 1]), best) < 100
    assert best.ids.tolist() == list(range(10))


def test_an_earlier_block_stops_a_later_one():
    rng = np.random.default_rng(5)
    block, best = block_of(rng, 2000, 12), rs.Best(10)
    best.add(np.arange(10), np.full(10, 1 << 50))
    assert rs.search(block, np.arange(5), best) <= 5 * rs.FIRST_STEP
