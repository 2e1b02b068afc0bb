"""Shards: even counts, gapless slots, groups of equal texts together."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from earshot.llm import sharding as sh
from earshot.llm.base import table


def checked(rows, got, shards=40):
    """The properties of every result; returns the shards of each text."""
    assert sorted(((i, t) for i, t in rows), key=str) == sorted(rows, key=str)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    counts = [0] * shards
    slots = defaultdict(list)
    held = defaultdict(Counter)
    for r in got:
        counts[r.shard] += 1
        slots[r.shard].append(r.slot)
        held[r.text_crc32][r.shard] += 1
        assert r.law == "rows" and r.grown_shard is None
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return held


def test_groups_stay_together(docs):
    rows = [(i, f"text of group {i % 150}" if i < 600 else f"text {i}") for i in range(2000)]
    held = checked(rows, sh.sharding_report(docs(rows)).collect())
    apart = [h for h in held.values() if sum(h.values()) > 1 and len(h) > 1]
    assert not apart


def test_huge_group_fills_few_shards(docs):
    rows = [(i, "one text that a third of all rows hold" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    held = checked(rows, sh.sharding_report(docs(rows)).collect())
    most = max(held.values(), key=lambda h: sum(h.values()))
    assert len(most) <= 20  # 1,000 rows need 14 shards of 75


def test_all_rows_linked(docs):
    rows = [(i, f"pair {i // 4}") for i in range(1200)]
    held = checked(rows, sh.sharding_report(docs(rows)).collect())
    cut = sum(sum(h.values()) - max(h.values()) for h in held.values())
    assert cut < 0.35 * 1200  # by chance nearly three of four are apart


def test_odd_rows(docs):
    rows = [(1, None), (2, ""), (None, "a"), (1, None), (None, None), (3, "é" * 50_000), (3, "é" * 50_000)]
    frame = docs(rows).selectExpr("doc_id", "text", "'x' as id", "1 as hub", "2 as shard", "3 as place")
    held = checked(rows, sh.sharding_report(frame).collect())
    assert len(held[0]) == 4  # with fewer rows than shards each holds at most one
    assert sh.sharding_report(docs([])).collect() == []


def test_real_documents(spark):
    got = sh.sharding_report(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    held = checked(rows, got)
    assert all(len(h) == 1 for h in held.values())


@pytest.mark.parametrize("seed", range(20))
def test_flow_never_overfills(seed):
    rng = np.random.default_rng(seed)
    asked = rng.integers(0, 100, (8, 8))
    np.fill_diagonal(asked, 0)
    room = rng.integers(-30, 60, 8)
    moved = sh.flow(asked, room)
    assert (moved <= asked).all() and (moved >= 0).all()
    # Rounding down may hold back one move of each pair that leaves.
    assert (moved.sum(axis=0) - moved.sum(axis=1) <= np.maximum(room, 0) + 8).all()
