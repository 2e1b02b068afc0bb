"""Line dedup against a plain version."""

import hashlib
import random
import re

from earshot.llm import line_dedup as ld


def plain(rows, min_chars=20, min_docs=3):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add((-1 << 63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = (-1 << 63) if doc is None else doc
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and own < max(held[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_against_plain(docs):
    rng = random.Random(1)
    shared = ["a line that many documents share", " A Line that many documents SHARE\t", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "éééééééééééééééééééé", "short line",
              "exactly twenty chars", "nineteen characters", "", "   ", "only two hold this line here"]
    rows = [(i, "\n".join(rng.choices(shared + [f"own line of document number {i} {rng.random()}"], k=rng.randint(0, 8)))) for i in range(60)]
    rows += [(7, None), (8, ""), (None, shared[0] + "\n" + shared[3]), (None, shared[0]), rows[0], rows[0], (61, "\n\n"), (62, shared[0])]
    frame = docs(rows).selectExpr("doc_id", "text", "1 as id", "'k' as key", "array('x') as keys", "2 as doc")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, ld.line_dedup_report(frame).collect()), key=key) == sorted(plain(rows), key=key)


def test_rows_of_one_id_are_one_document(docs):
    line = "the very same line of text"
    frame = docs([(1, line), (1, line), (2, line)])
    assert {r.n_dropped for r in ld.line_dedup_report(frame).collect()} == {0}


def test_empty_table_and_columns(docs):
    assert ld.line_dedup_report(docs([])).collect() == []
    frame = docs([(1, "x")]).selectExpr("doc_id", "text", "1 as kept")
    assert ld.dedup_lines(frame).first().doc.kept == 1


def test_bytes_that_are_no_text(docs):
    line = "41ff" * 12
    odd = docs([(i, f"{line}0a6f776e{i:02d}") for i in range(3)]).selectExpr("doc_id", "cast(unhex(text) as string) as text")
    found = ld.dedup_lines(odd).selectExpr("doc.doc_id as id", "n_dropped", "cast(kept as binary) as raw")
    got = {r.id: (r.n_dropped, bytes(r.raw)) for r in found.collect()}
    assert got == {0: (1, b"own\x00"), 1: (1, b"own\x01"), 2: (0, bytes.fromhex(line) + b"\nown\x02")}
