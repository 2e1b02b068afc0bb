"""Byte-level BPE: pieces give the ids of the whole text, ids give the bytes."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import bpe

ENCODING, DIGITS = bpe.load(bpe.default_rank_file())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Z'sté9\n\t ,.<|>　🙂", max_size=60), st.integers(1, 9))
def test_pieces(text, size):
    assert "".join(bpe.safe_pieces(text, size)) == text
    ids = bpe.encode(text, ENCODING, size)
    assert ids == ENCODING.encode_ordinary(text)
    assert ENCODING.decode_bytes(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 150_000, " " * 150_000 + "x", "ab " * 80_000, "🙂" * 40_000, "1" * 120_000 + " end"])
def test_long_texts(text):
    ids = bpe.encode(text, ENCODING)
    assert ENCODING.decode_bytes(ids) == text.encode()
    assert ids == ENCODING.encode_ordinary(text)


def test_merges_by_rank():
    """A plain merge loop over one match gives the same ids."""
    ranks = {ENCODING.decode_single_token_bytes(i): i for i in range(len(DIGITS))}
    rng = random.Random(2)
    for _ in range(60):
        word = "".join(rng.choices("abcdeothñé", k=rng.randint(1, 25)))
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            pairs = [(ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, k = min(pairs)
            if rank == 1 << 60:
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        assert bpe.encode(word, ENCODING) == [ranks[p] for p in parts]


def test_report_and_round_trip(docs):
    rows = [(1, "Hello <|endoftext|> ñandú"), (1, "Hello <|endoftext|> ñandú"), (2, None), (3, ""), (None, "x\n\n y")]
    frame = docs(rows).selectExpr("doc_id", "text", "1 as id", "2 as tokens")
    want = []
    for i, t in rows:
        ids = ENCODING.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip_report(frame).collect()), key=str) == sorted(want, key=str)
    encoded = bpe.encode_texts(frame)
    assert sorted(bytes(r.bytes) for r in bpe.decode_tokens(encoded).collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip_report(docs([])).collect() == []


def test_a_separator_after_punctuation_is_no_boundary():
    encoding, _ = bpe.load(bpe.default_rank_file())
    text = ("word " * 30)[:100] + "!\x1c!\x1f?" * 60 + " end of it" * 40
    for size in (90, 100, 101, 110):
        assert bpe.encode(text, encoding, size) == encoding.encode_ordinary(text)


def test_bytes_that_are_no_text(docs):
    odd = docs([(1, "6162ff63")]).selectExpr("doc_id", "cast(unhex(text) as string) as text")
    row = bpe.round_trip_report(odd).first()
    assert row.decoded_sha256 == hashlib.sha256("ab\ufffdc".encode()).hexdigest()
