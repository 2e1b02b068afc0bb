"""Substring dedup against a plain version over all strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from earshot.llm import suffix_dedup as sd


def plain(rows, length=50):
    """(id, n_bytes, n_removed, n_spans, kept) by listing every string."""
    ids = [(-1 << 63) if i is None else i for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    least = {}
    for i, t in zip(ids, texts):
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for (given, _), i, t in zip(rows, ids, texts):
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if least[t[p:p + length]] < i:
                gone[p:p + length] = [True] * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((given, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def same(found, rows):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(rows), key=key)


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "δέλτα", "été", "x", "the", "of", "-", "aa"]
    shared = [" ".join(rng.choices(words, k=rng.randint(6, 40))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 60)))
                 for _ in range(rng.randint(0, 4))]
        rows.append((rng.randint(0, n // 2), rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(7, "a" * 500), (3, "b" * 49 + "a" * 130), (9, "ab" * 200), (2, "ab" * 30), (50, rows[0][1]), (51, rows[1][1] * 2)]
    rows += [(60, None), (61, ""), (None, shared[0] * 2), (None, shared[0]), (5, "é" * 60), (6, "x" + "é" * 60), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 23, 700])
def test_against_plain(docs, block_bytes):
    rows = corpus(block_bytes)
    found = sd.repeated_spans(docs(rows), block_bytes=block_bytes)
    got = found.rdd.map(lambda r: (r.id if r.id != -(1 << 63) else None, r.n_bytes, sum(s.end - s.start for s in r.spans),
                                   len(r.spans), hashlib.sha256(r.kept).hexdigest())).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_report_and_clashing_columns(docs):
    rows = corpus(3)
    frame = docs(rows).selectExpr("doc_id", "text", "text as id", "1 as block", "2 as bucket", "3 as n_bytes")
    same(sd.substring_dedup_report(frame), rows)


def test_empty_table(docs):
    assert sd.substring_dedup_report(docs([])).collect() == []


def test_suffix_sort_is_lexicographic():
    rng = random.Random(1)
    text = "".join(rng.choices("ab", k=400)) + "c" * 100 + "".join(rng.choices("abc", k=300))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    suffixes = np.arange(len(data) - 20 + 1)
    order = sd.merge_sort(sd.PrefixHashes(data), data, suffixes, np.zeros(len(suffixes), dtype=np.int64), 20)
    assert [text[i:i + 20] for i in suffixes[order]] == sorted(text[i:i + 20] for i in suffixes)


def test_collisions_are_compared_byte_by_byte(monkeypatch):
    """With a hash that is always equal, classes still hold equal strings only."""
    monkeypatch.setattr(sd.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), dtype=np.uint64))
    data = np.frombuffer(b"abcabcabdabd", dtype=np.uint8)
    suffixes = np.arange(0, 10, 3)
    order, number = sd.classes(data, sd.PrefixHashes(data), np.arange(4), suffixes, np.zeros(4, dtype=np.int64), 3)
    strings = [bytes(data[i:i + 3]) for i in suffixes[order]]
    assert all((a == b) == (x == y) for a, x in zip(strings, number) for b, y in zip(strings, number))


def test_runs_carry_every_suffix_once():
    texts = ["a" * 300, "abc" * 50, "short", "", "the quick brown fox " * 9]
    block = sd.Block(pa.table({"id": [3, 1, 2, 0, 4], "text": texts}), 50, 24)
    covered = [p for s, n in zip(block.first.tolist(), block.count.tolist()) for p in range(s, s + n)]
    wanted = [p for a, z in zip(block.starts, block.starts[1:]) for p in range(a, z - 50 + 1)]
    assert covered == wanted
