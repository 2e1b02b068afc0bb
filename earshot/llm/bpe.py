"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before a run of white space that follows something else. No match of the splitting pattern reaches
over such a place (white space only starts a match or makes up all of it, and the pattern looks ahead only from white
space), so the pieces' tokens joined are the text's tokens, and no call sees an unbounded text. Ids decode to raw bytes;
a token may end inside a character.

Edge cases: a null or empty text has no tokens and decodes to no bytes; strings that look like special tokens are
ordinary text; bytes that are no UTF-8 are encoded as U+FFFD; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.base import given_id, keyed_texts, record, text_strings

#: Code points of a text that are encoded at once, up to the next safe boundary.
PIECE_CHARS = 100_000

# Only blanks and newlines end a piece: what else counts as white space differs between this module and the tokenizer.
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")


def default_rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def load(rank_file: str, pattern: str | None = None) -> tuple[tiktoken.Encoding, list[str]]:
    """The encoding, and each id's decimal digits. Loaded once in each worker.

    The file must be installed at the same path on every machine; a rank file is part of the environment, not of the data.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding, [str(i) for i in range(max(ranks.values(), default=0) + 1)]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of at least ``size`` code points (the last may be shorter) that end at safe boundaries."""
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, encoding: tiktoken.Encoding, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, size):
        ids += encoding.encode_ordinary(piece)
    return ids


_TOKENS = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.int32()))])
_DIGESTS = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_texts(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, tokens) per document."""
    rank_file = rank_file or default_rank_file()

    def run(batches):
        encoding, _ = load(rank_file, pattern)
        for batch in batches:
            yield record(_TOKENS, id=batch.column("id"), tokens=[encode(t, encoding) for t in text_strings(batch.column("text"))])
    return keyed_texts(docs).mapInArrow(run, "id long, tokens array<int>")


def decode_tokens(encoded: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, bytes): raw bytes of the tokens of each row of (id, tokens)."""
    rank_file = rank_file or default_rank_file()
    schema = pa.schema([("id", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        encoding, _ = load(rank_file, pattern)
        for batch in batches:
            yield record(schema, id=batch.column("id"), bytes=[encoding.decode_bytes(t or []) for t in batch.column("tokens").to_pylist()])
    return encoded.select("id", "tokens").mapInArrow(run, "id long, bytes binary")


def round_trip_report(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """The digest columns of query op5; encoded and decoded in one pass, so tokens are never stored."""
    rank_file = rank_file or default_rank_file()

    def run(batches):
        encoding, digits = load(rank_file, pattern)
        for batch in batches:
            counts, ids_hex, bytes_hex = [], [], []
            for text in text_strings(batch.column("text")):
                ids = encode(text, encoding)
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
                bytes_hex.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            yield record(_DIGESTS, id=batch.column("id"), n_tokens=counts, ids_sha256=ids_hex, decoded_sha256=bytes_hex)
    found = keyed_texts(docs).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.select(given_id(), "n_tokens", "ids_sha256", "decoded_sha256")
