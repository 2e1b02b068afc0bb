"""SimHash against plain versions: fingerprints bit by bit, components by comparing all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from earshot.llm import simhash as sh


def plain_print(text, words_in=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + words_in]) for i in range(max(1, len(words) - words_in + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """Index of each print's group by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def near_prints(seed, n=300):
    rng = random.Random(seed)
    out = []
    for _ in range(n // 6):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 11)):
            out.append(at)
            for _ in range(rng.randint(0, 5)):
                at ^= 1 << rng.randrange(64)
    return out + [0, 1, (1 << 64) - 1]


@pytest.mark.parametrize("block_prints", [4096, 40])
def test_links_against_all_pairs(spark, docs, block_prints):
    prints = sorted(set(near_prints(block_prints)))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    found = dict(map(tuple, sh.components(sh.print_links(frame, block_prints=block_prints)).collect()))
    groups = plain_components(prints)
    mine, theirs = {}, {}
    for p, g in zip(signed, groups):
        mine.setdefault(found.get(p, p), set()).add(p)
        theirs.setdefault(g, set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_report_against_plain(docs):
    rng = random.Random(5)
    words = "alpha Beta gamma δέλτα ÉTÉ x the of - aa".split()
    rows = []
    for i in range(60):
        text = rng.choice([" ", "\n", "\t "]).join(rng.choices(words, k=rng.choice([0, 1, 3, 4, 9, 80])))
        rows.append((i * 3, text))
        for k in range(rng.randint(0, 2)):
            rows.append((i * 3 + k + 1, text.replace("x", "y", 1)))
    rows += [(500, None), (501, ""), (502, " \n"), rows[0], rows[0], (None, "lonely words here and there again")]
    frame = docs(rows).selectExpr("doc_id", "text", "1 as id", "2 as print", "3 as component")
    prints = [plain_print(t) for _, t in rows]
    groups = plain_components(prints)
    ids = [(-1 << 63) if i is None else i for i, _ in rows]
    least = {}
    for g, i in zip(groups, ids):
        least[g] = min(least.get(g, i), i)
    want = [(i, f"{p:016x}", least[g] if least[g] > -(1 << 63) else None) for (i, _), p, g in zip(rows, prints, groups)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, sh.near_duplicate_report(frame).collect()), key=key) == sorted(want, key=key)


def test_one_row_of_each_group_stays(docs):
    text = "one two three four five six seven eight"
    frame = docs([(5, text), (3, text), (3, text), (9, "quite another text it is"), (4, None), (2, "")])
    assert sorted(sh.keep_first_of_group(frame).collect()) == [(2, ""), (3, text), (9, "quite another text it is")]


def test_empty_table(docs):
    assert sh.near_duplicate_report(docs([])).collect() == []


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 5, 3000):
        values = np.unique(rng.integers(0, 1 << 33, n).astype(np.uint64))
        assert (sh.unpack(sh.pack(values, 20)) == values).all()
    assert len(sh.unpack(sh.pack(values[:0], 20))) == 0


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        sh.print_links(spark.range(1).withColumnRenamed("id", "print"), radius=3)
