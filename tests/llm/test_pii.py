"""Patterns against plain regular expressions, the CRF against enumeration and on held-out rows."""

import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import pii


def plain_base(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", r"\x20\-"), text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(d[::-1])) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(spans)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "0", "300", ".", ".1", "1.2.3.4", "@", "a@b.c", "x.y+z", "-", " ", "+", "+1", "(", ")", "é", "\n",
                                 "4111111111111111", "5500 0000 0000 0004", "555-1234", "(212) ", "a", "_", "%"]), max_size=25))
def test_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_base(text)


def test_long_runs_are_scanned_in_linear_time():
    text = "1" * 60_000 + "." + "a" * 60_000 + "@" + "1." * 20_000 + "+1" * 20_000 + "+1" + " (" * 20_000
    assert pii.base_spans(text) is not None and pii.chains(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    n = len(pii.LABELS)
    model = pii.ChainModel({"a": 0, "b": 1}, rng.normal(size=(2, n)), rng.normal(size=(n, n)) + pii._ALLOWED)
    chain = [["a"], ["b"], ["a", "b"]]
    scores = model.scores(chain)

    def value(path):
        return pii._START[path[0]] + sum(scores[k, y] for k, y in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))
    best = max(itertools.product(range(n), repeat=3), key=value)
    assert [list(x) for x in model.decode([chain, chain[:1], chain])][0] == list(best)


def test_model_learns_the_table():
    rows = pii.labelled_table(400, seed=99)
    decoded = pii.default_model().decode([pii.chain_features(w, b) for w, b, _ in rows])
    right = [x == pii.LABELS[y] for (_, _, labels), d in zip(rows, decoded) for x, y in zip(labels, d)]
    assert np.mean(right) > 0.95


def test_added_spans():
    texts = ["please call (212) 555-0199, thanks", "my card 4111 1111 1111 1112 ok", "nothing of 2024 or 3.14 in here", ""]
    found = pii.find_spans(texts, pii.default_model())
    assert [[(pii.KINDS[k], t[a:z]) for a, k, z in added] for t, (_, added) in zip(texts, found)] == [
        [("phone", "(212) 555-0199")], [("card", "4111 1111 1111 1112")], [], []]


def test_plain_prose_has_no_spans():
    rng = random.Random(1)
    text = " ".join(rng.choices(["the", "of", "in 1999,", "about 40%", "see 3.2", "v2.0", "at 12:30", "#4411"], k=3000))
    assert pii.find_spans([text], pii.default_model()) == [([], [])]


def test_report(docs):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (2, None), (3, ""), (None, "é 10.0.0.1 +1 (212) 555-0199")]
    got = sorted(map(tuple, pii.personal_data_report(docs(rows).selectExpr("doc_id", "text", "1 as id", "2 as spans")).collect()), key=str)

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()
    both = "ip:2:10,phone:11:28"
    assert got == sorted([(1, 1, 0, 0, 0, sha("email:0:6"), "email:0:6")] * 2 + [(2, 0, 0, 0, 0, sha(""), ""), (3, 0, 0, 0, 0, sha(""), ""),
                         (None, 0, 1, 0, 1, sha(both), both)], key=str)
    assert pii.personal_data_report(docs([])).collect() == []


def test_long_numbers(docs):
    long = "0" * 5000 + ".0.0.0"
    assert [(k, z - a) for a, k, z in pii.base_spans(long)] == [(1, len(long))]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []
    rows = [(1, "ip " + long + " and " + "7" * 6000 + ".1.2.3"), (2, "x" * 300_000 + "1 " + " " * 1000 + "5" * 10_000)]
    got = {r.doc_id: (r.n_ip, r.n_card) for r in pii.personal_data_report(docs(rows)).collect()}
    assert got == {1: (1, 0), 2: (0, 0)}


def test_features_see_whole_words_and_all_blanks():
    assert pii.shape("ab" * 100 + "1") != pii.shape("ab" * 100 + "-")
    assert pii.word_features("x" * 300 + "12345")[2] == "n=5"
    text = "tel" + " " * 500 + "555 1234"
    assert pii._word_before(text, text.index("555")) == "tel" and pii._word_before("555", 0) == ""


def test_spans_as_structs(docs):
    odd = docs([(1, "ff20612e62406578616d706c652e636f6d")]).selectExpr("doc_id", "cast(unhex(text) as string) as text")
    row = pii.personal_data(odd).first()
    assert [(s.start, s.end, s.kind, s.base) for s in row.spans] == [(2, 17, "email", True)]
