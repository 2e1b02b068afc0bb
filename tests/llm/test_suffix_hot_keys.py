"""Substring dedup where one passage stands in many different surroundings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from earshot.llm import suffix_dedup as sd

from tests.llm.test_suffix_dedup import corpus, plain


def surrounded(seed, n):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=k))
    passage = text(300)
    return [(i, text(rng.randint(60, 90)) + passage + text(rng.randint(60, 90))) for i in range(n)]


def bucket_bytes(rows, hot_bytes, buckets=16, blocks=8):
    """Most bytes of text that one bucket gets, all steps up to it run by hand."""
    tables = [pa.table({"block": [b] * len(rows[b::blocks]), "id": [i for i, _ in rows[b::blocks]], "text": [t for _, t in rows[b::blocks]]})
              for b in range(blocks)]
    listed = pa.concat_tables([sd._list_keys(50, 24, buckets)(t) for t in tables])
    wanted = pa.concat_tables([sd._shared_keys(hot_bytes)(listed.filter(pa.compute.equal(listed["bucket"], k))) for k in range(buckets)])
    size = np.zeros(buckets, dtype=int)
    for b, t in enumerate(tables):
        sent = sd._send_runs(50, 24, buckets)((pa.scalar(b),), t, wanted.filter(pa.compute.equal(wanted["block"], b)))
        for k, text in zip(sent["bucket"].to_pylist(), sd._freed(sent["text"], "u1")):
            size[k] += len(text)
    return size


def test_no_bucket_holds_all_surroundings():
    rows = surrounded(1, 800)
    whole, dealt = bucket_bytes(rows, 1 << 40), bucket_bytes(rows, 1 << 12)
    assert whole.max() > 2.5 * np.mean(whole)
    assert dealt.max() < 1.5 * np.mean(dealt)


@pytest.mark.parametrize("hot_bytes", [0, 2000])
def test_dealt_suffixes_against_plain(docs, hot_bytes):
    rows = surrounded(2, 60) + [(i if i is None else i + 100, t) for i, t in corpus(5)]
    found = sd.repeated_spans(docs(rows), block_bytes=4000, hot_bytes=hot_bytes)
    got = [(r.id if r.id != -(1 << 63) else None, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
           for r in found.collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
