"""One-permutation MinHash against a plain version, and its estimates against true similarities."""

import hashlib
import random
import re

import pytest
import xxhash

from earshot.llm import minhash as mh

ALL = (1 << 64) - 1


def xx(values, seed=42):
    """Spark's xxhash64 of several values: each is hashed with the hash so far as seed; nulls are passed over."""
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else (v & ((1 << 32) - 1)).to_bytes(4, "little") if v.__class__ is Int else v.to_bytes(8, "little")
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


class Int(int):
    pass


def plain_lows(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    own = [xx([w]) for w in words]
    if len(own) >= mh.SHINGLE:
        hashes = [xx(own[i:i + mh.SHINGLE]) for i in range(len(own) - mh.SHINGLE + 1)]
    else:
        hashes = [xx([*own[:mh.SHINGLE - 1], Int(len(own))])]
    least = {}
    for h in hashes:
        b = h >> 64 - mh.BIN_BITS ^ mh.BINS // 2  # bins in the order of signed numbers
        least[b] = min(least.get(b, ALL), h)
    return [(least[b] if b in least else next(least[p] for p in mh.probes(b) if p in least)) & (1 << mh.LOW_BITS) - 1 for b in range(mh.BINS)]


def plain_report(rows):
    ids = lambda r: (-1 << 63) if r[0] is None else r[0]
    ordered = sorted(rows, key=lambda r: (ids(r), (r[1] or "").encode()), reverse=True)
    out = []
    for k, (i, text) in enumerate(ordered):
        text, other = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        a, b, c = plain_lows(text), plain_lows(edited), plain_lows(other)

        def near(x, y):
            chance = 1 / (1 << mh.LOW_BITS)
            return round(max(0.0, (sum(p == q for p, q in zip(x, y)) / mh.BINS - chance) / (1 - chance)), 9)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), near(a, b), near(a, c)))
    return out


def check(found, rows):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in found.collect()]
    assert sorted(got, key=key) == sorted(plain_report(rows), key=key)


def some_rows():
    rng = random.Random(2)
    words = "alpha Beta gamma δέλτα ÉTÉ x the of - aa".split()
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choices(words, k=rng.choice([0, 1, 4, 5, 6, 30, 400]))) for _ in range(30)]
    return [(i * 700 - 3000, t) for i, t in enumerate(texts)] + [(7, None), (7, ""), (9, "same text"), (10, "same text"), (1 << 40, "far"), (1 << 50, " ")]


def test_against_plain(docs):
    rows = some_rows()
    check(mh.fingerprint_report(docs(rows).selectExpr("doc_id", "text", "1 as id", "2 as next", "3 as lows", "4 as range")), rows)


@pytest.mark.parametrize("rows", [[], [(3, "alone here")], [(None, "no id"), (1, "a b c d e f"), (1, "a b c d e f")]])
def test_small_tables(docs, rows):
    check(mh.fingerprint_report(docs(rows)), rows)


def test_probes_visit_every_bin():
    assert all(sorted(mh.probes(b)) == list(range(mh.BINS)) for b in range(mh.BINS))
    assert len({tuple(mh.probes(b)[:4]) for b in range(mh.BINS)}) == mh.BINS


def test_estimates_are_near_the_truth():
    rng = random.Random(4)
    errors = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for _ in range(4):
            a = [f"w{rng.randrange(10**9)}" for _ in range(900)]
            b = a[:int(900 * share)] + [f"v{rng.randrange(10**9)}" for _ in range(900 - int(900 * share))]
            sets = [{tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            x, y = plain_lows(" ".join(a)), plain_lows(" ".join(b))
            errors.append((sum(p == q for p, q in zip(x, y)) / mh.BINS - 1 / 256) / (255 / 256) - true)
    assert max(map(abs, errors)) < 0.12 and abs(sum(errors) / len(errors)) < 0.03


def test_plan_is_native(docs):
    plan = mh.fingerprint_report(docs(some_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
