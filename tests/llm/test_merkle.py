"""The Merkle manifest against a plain version, and against what tampering must break."""

import hashlib
import zlib

import pytest

from earshot.llm import merkle as mk


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha(*map(plain_field, (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """Root, and for each digest its siblings by level as (left, right)."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for path, k in zip(paths, at):
            run = k - k % 16
            path.append(("".join(digests[run:k]), "".join(digests[k + 1:run + 16])))
        digests = [sha(*digests[k:k + 16]) for k in range(0, len(digests), 16)]
        at = [k // 16 for k in at]
    return digests[0], paths


def plain(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[s] = (own, *climb([plain_leaf(*r) for r in own]))
    root, upper = climb([trees[s][1] for s in names])
    out = []
    for s, above in zip(names, upper):
        own, subroot, paths = trees[s]
        for row, path in zip(own, paths):
            path = path + above
            doc_id, _, _, _, text = row
            changed = row
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                changed = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            fold = plain_leaf(*changed)
            for left, right in path:
                fold = sha(left, fold, right)
            out.append((doc_id, plain_leaf(*row), subroot, root, sha(*(a + z for a, z in path)), fold, fold == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def found(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in mk.manifest_report(spark.createDataFrame(rows, schema)).collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (16, 17), (300, 1, 5, 33), (257,) + (1,) * 20])
def test_against_plain(spark, docs, sizes):
    rows = [(1000 * k + i * 7 % 997, None if k == 1 else f"s{k}", "en", i, f"Text {i} OF é {k}") for k, n in enumerate(sizes) for i in range(n)]
    assert found(spark, rows) == sorted(plain(rows), key=str)


def test_odd_rows(spark, docs):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a", "", 0, ""), (None, "a", "x", 0, None), (-5, "", "é", -1, "ÄB"),
            (10, "B", "en", 2, "A" * 100_000), (10, "B", "en", 2, "a" * 100_000)]
    assert found(spark, rows) == sorted(plain(rows), key=str)
    assert found(spark, []) == []


def test_further_columns(spark, docs):
    names = "tree lo hi n path digest changed place start".split()
    rows = [(i, "s", "en", 1, "Text", *names) for i in range(40)]
    schema = SCHEMA + "".join(f", {n} string" for n in names)
    assert found(spark, rows, schema) == sorted(plain([r[:5] for r in rows]), key=str)


def test_what_is_tampered_fails(spark, docs):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(100)]
    for doc_id, *_, verified in found(spark, rows):
        assert verified == (doc_id % 2 == 0 or zlib.crc32(str(doc_id).encode()) % 5 != 0)
