"""The automaton against substring search, base places against a plain scan, chains on edited licences."""

import random

import pytest

from earshot.llm import licenses as li
from earshot.llm.base import word_bytes


def plain_places(words):
    out = []
    for phrase, label in li.BASE_PHRASES.items():
        p = word_bytes(phrase.encode())
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return sorted(out)


def test_matching_statistics():
    rng = random.Random(3)
    templates = {"x": " ".join(rng.choices("abc", k=40)), "y": " ".join(rng.choices("abc", k=30)), "z": "a b"}
    phrases = {"b a": "p", "c c a": "q", "q r": "r", "a": "s"}
    machine = li.SuffixAutomaton(list(templates.items()), phrases)
    known = [word_bytes(t.encode()) for t in (*templates.values(), *phrases)]
    text = [w.encode() for w in rng.choices("abcqrz", weights=[9, 9, 9, 2, 2, 1], k=3000)]
    matches, ended = machine.statistics(text)

    def occurs(part):
        return any(w[i:i + len(part)] == part for w in known for i in range(len(w)))
    for k, state, matched in matches:
        assert occurs(text[k - matched + 1:k + 1])
        assert k + 1 == len(text) or not occurs(text[k - matched + 1:k + 2])
        assert k - matched < 0 or not occurs(text[k - matched:k + 1])
        own = text[k - matched + 1:k + 1]
        at = {(t, i + matched - 1) for t, w in enumerate(known[:3]) for i in range(len(w)) if w[i:i + matched] == own}
        assert at == machine.places[state]
    found = sorted((k - size + 1, label) for k, state, matched in ended for size, label in machine.phrases[state] if matched >= size)
    want = sorted((i, label) for phrase, label in phrases.items() for p in [word_bytes(phrase.encode())]
                  for i in range(len(text) - len(p) + 1) if text[i:i + len(p)] == p)
    assert found == want


def test_base_places():
    rng = random.Random(8)
    bits = ["under the mit", "under the mit license", "Apache License, Version 2", "apache license", "version 2.0", "CC BY-NC", "cc", "by", "nc",
            "license under the", "word"]
    for _ in range(200):
        words = word_bytes(" ".join(rng.choices(bits, k=30)).encode())
        assert [(s.first, s.label) for s in li.scan(li.default_automaton(), words)[0] if s.base] == plain_places(words)


def found(text):
    """{label: cover} of the licences that chains find."""
    spans, _ = li.scan(li.default_automaton(), word_bytes(text.encode()))
    return {s.label: s.cover for s in spans if not s.base}


def test_chains_bridge_edits_and_stay_clear_of_prose():
    machine = li.default_automaton()
    words = word_bytes(li.TEMPLATES["bsd"][0].encode())
    spans, cover = li.scan(machine, [b"x"] + words)
    assert spans == [li.Span("bsd", 1, len(words), 1.0, False)] and cover == 1.0
    edited = words[:8] + [b"xx", b"yy"] + words[9:]
    spans, cover = li.scan(machine, edited)
    assert [s.label for s in spans] == ["bsd"] and li.MIN_COVER <= spans[0].cover < 1.0 and (spans[0].first, spans[0].last) == (0, len(edited) - 1)
    prose = word_bytes(("the terms of the contract are subject to the following conditions and the copies of the software " * 40).encode())
    assert li.scan(machine, prose)[0] == [] and li.scan(machine, prose)[1] < li.MIN_COVER


def test_every_text_is_known_by_its_own_label():
    for label, texts in li.TEMPLATES.items():
        for text in texts:
            assert set(found(text)) == {label}, text[:60]
            assert set(found("Before that. " + text + " And some words after.")) == {label}


@pytest.mark.parametrize("text, label", [
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "cc-by-nc-sa"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl")])
def test_sister_licences_are_told_apart(text, label):
    assert set(found(text)) == {label}


def test_two_licences_in_one_text():
    text = li.TEMPLATES["mit"][1] + " ---- " + li.TEMPLATES["bsd-3"][0]
    assert found(text) == {"mit": 1.0, "bsd-3": 1.0}


def plain_chains(places):
    """Best words covered by a chain that ends with each match, over all chains; ``places``: (text first, last, template first, last)."""
    best = []
    for k, (a, z, c, d) in enumerate(places):
        own = z - a + 1
        before = [best[j] for j, (_, y, _, x) in enumerate(places[:k]) if y < a <= y + li.MAX_GAP + 1 and x < c <= x + li.MAX_GAP + 1]
        best.append(own + max(before, default=0))
    return best


def test_chains_against_all_chains():
    rng = random.Random(5)
    for _ in range(60):
        template = rng.choices("abcdefgh", k=60)
        text = template[:]
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(text))
            text[at:at + rng.randint(0, 3)] = rng.choices("abcdefghxyz", k=rng.randint(0, 4))
        machine = li.SuffixAutomaton([("t", " ".join(template))], {})
        matches, _ = machine.statistics([w.encode() for w in text])
        places = [(k - n + 1, k, end - n + 1, end) for k, state, n in matches for _, end in machine.places[state]]
        got = li.chained(machine, matches)
        assert [n for _, _, _, n in got] == plain_chains(places)
        assert all(first <= p[0] and last == p[1] for (_, first, last, _), p in zip(got, places))


def test_report(docs):
    rows = [(1, "Licensed under the MIT license."), (1, "Licensed under the MIT license."), (2, None), (3, ""), (None, "CC BY-NC 4.0, cc by nc"),
            (5, "x " + li.TEMPLATES["bsd"][0])]
    frame = docs(rows).selectExpr("doc_id", "text", "1 as id", "2 as score")
    got = sorted(map(tuple, li.license_report(frame).collect()), key=str)
    want = [(1, 5, 1, 1, 1, "mit", "mit", 1.0)] * 2 + [(2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
            (None, 8, 2, 0, 5, "cc-by-nc", "cc-by-nc", 1.0), (5, len(word_bytes(rows[5][1].encode())), 0, None, None, "", "bsd", 1.0)]
    assert got == sorted(want, key=str)
    assert li.license_report(docs([])).collect() == []
