"""Exact substring dedup by a hash-compared suffix sort, dealt over the cluster.

Every byte of a text that lies in a string of ``length`` bytes which also starts in a document of smaller id is
removed. Strings are bytes, never reach over the end of a text, overlap freely and are judged on the input.

How the suffixes are dealt. The key of a suffix is the least hash of the ``gram``-byte strings within its first
``length`` bytes. Equal strings have equal keys, and neighbouring suffixes mostly share theirs, so a run of suffixes
with one key travels as one short string. Five steps, all of whose groups are bounded by blocks of some megabytes:

1. ``block``: texts are dealt into blocks by a hash of the row; each block lists its distinct keys, once each.
2. ``bucket``: keys are dealt by hash; a key stays if two blocks, or two documents of one block, hold it.
3. ``block``: the runs of suffixes with such keys are cut out, equal ones once with the smallest id that holds them.
4. ``bucket``: the suffixes of all runs of a key are sorted by a mergesort that compares two suffixes by the length of
   their common start, found by binary search over prefix polynomial hashes. Neighbours that agree in ``length`` bytes
   form a class; their bytes are compared, so a hash collision cannot remove anything. A suffix whose class holds a
   smaller id is marked.
5. ``block``: marks become removed bytes.

A text is written to the shuffle once; the three block steps read the same exchange. Inside a passage that any number of
documents share, equal runs are sent once per block. At its ends runs hold bytes of the surroundings too, so they differ
in each document. Blocks therefore tell the bytes of a key's distinct runs in step 1, and the suffixes of a key that exceeds
``hot_bytes`` in all travel one by one in step 3, once per block, dealt by a hash of their ``length`` bytes.

Edge cases: a null text is empty; texts under ``length`` bytes lose nothing; a null id counts as the smallest; rows of
one id never remove each other's bytes, so repeated rows give equal results; an empty table gives an empty result;
further columns are ignored. ``kept`` may cut through a character, so it is binary.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.base import given_id, keyed_texts, text_bytes

#: Bytes of text in a block, and about the bytes of runs in a bucket.
BLOCK_BYTES = 4 << 20
#: Bytes of distinct runs from which a key's suffixes are dealt one by one.
HOT_BYTES = BLOCK_BYTES // 4
#: Runs of a key in a block from which equal ones are told apart to find their bytes, and the unit these are told in.
MANY_RUNS, UNIT = 16, 64
#: Bytes worked on at once, so that temporaries stay in the processor's cache.
CHUNK = 1 << 18
#: Suffixes of one run; longer runs of one key are cut, each part keeps the key.
RUN = 64
#: Bytes of a key that step 1 sends. A coincidence only sends a run for nothing.
KEY_BYTES = 6

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    if n <= 2 * CHUNK:
        return _first_powers(base)[:n]
    steps = np.full(n, _u64(base))
    steps[0] = 1
    return np.cumprod(steps, out=steps)


@lru_cache(maxsize=2)
def _first_powers(base: int) -> np.ndarray:
    steps = np.full(2 * CHUNK, _u64(base))
    steps[0] = 1
    return np.cumprod(steps, out=steps)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _u64(31))
    h *= _u64(0xBF58476D1CE4E5B9)
    h ^= h >> _u64(29)
    h *= _u64(0x94D049BB133111EB)
    return h ^ (h >> _u64(32))


class PrefixHashes:
    """Polynomial hash of any substring from two prefix sums: sum of byte * base^position, scaled back by position."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        terms = self.sums[1:]
        terms += data
        terms += _u64(1)
        terms *= _powers(_BASE, n + 1)[:n]
        np.cumsum(terms, out=terms)
        self.scale = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.scale[start]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed hash of each ``gram``-byte string of ``data``."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    sums = PrefixHashes(data)
    return _mixed((sums.sums[gram:] - sums.sums[:n]) * sums.scale[:n])


def suffix_keys(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string of ``length`` bytes, the least hash of the grams inside it."""
    count = len(data) - length + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(count, dtype=np.uint64)
    width = length - gram + 1
    for at in range(0, count, CHUNK):
        part = data[at:min(at + CHUNK, count) + length - 1]
        low, span = gram_hashes(part, gram), 1
        while span * 2 <= width:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < width:
            low = np.minimum(low[:-(width - span)], low[width - span:])
        out[at:at + len(low)] = low
    return out


def run_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each string ``data[first:first + size]``; ``first`` ascends."""
    out = np.empty(len(first), dtype=np.uint64)
    most = int(size.max()) if len(size) else 0
    for at in range(0, len(data), CHUNK):
        a, z = np.searchsorted(first, [at, at + CHUNK])
        if a < z:
            out[a:z] = PrefixHashes(data[at:at + CHUNK + most]).of(first[a:z] - at, size[a:z])
    return out


class Block:
    """The texts of a block in order of id, one after the other, and their runs of suffixes with one key."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        order = np.argsort(np.array(table.column("id").to_pylist(), dtype=np.int64), kind="stable")
        texts = list(text_bytes(table.column("text")))
        self.order = order
        self.texts = [texts[i] for i in order]
        self.ids = np.array(table.column("id").to_pylist(), dtype=np.int64)[order]
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.length = length
        keys = suffix_keys(self.data, length, gram)
        # Suffixes too near to the end of their text do not count.
        real = np.zeros(len(keys) + 1, dtype=bool)
        for a, z in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            if z - a >= length:
                real[a:z - length + 1] = True
        real = real[:-1]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = keys[1:] != keys[:-1]
        fresh[self.starts[:-1][self.starts[:-1] < len(keys)]] = True
        heads = np.flatnonzero(fresh & real)
        if len(heads):
            # A run ends at the next head or at the first suffix that does not count.
            stops = np.flatnonzero(fresh | ~real)
            stops = np.append(stops, len(keys))
            ends = stops[np.searchsorted(stops, heads, side="right")]
        else:
            ends = heads
        parts = -(-(ends - heads) // RUN)
        if len(parts) and parts.max() > 1:
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(heads, parts) + nth * RUN
            ends = np.minimum(first + RUN, np.repeat(ends, parts))
            heads = first
        self.first, self.count, self.keys = heads, ends - heads, keys[heads] if len(heads) else keys[:0]
        self.doc = np.searchsorted(self.starts, heads, side="right") - 1

    def units(self, keys: np.ndarray) -> np.ndarray:
        """Bytes of the runs of each of the distinct keys in units; of many runs with one key, equal ones count once."""
        by_key, number = np.argsort(keys), np.empty(0, dtype=np.int64)
        if len(keys):
            number = by_key[np.searchsorted(keys[by_key], self.keys)]
        many = np.flatnonzero(np.bincount(number, minlength=len(keys))[number] > MANY_RUNS)
        alone = np.ones(len(number), dtype=bool)
        alone[many] = False
        alone[many[numbered(self.data, self.first[many], self.count[many] + self.length - 1)[1]]] = True
        size = np.bincount(number[alone], weights=self.count[alone] + self.length - 1, minlength=len(keys))
        return np.minimum(-(-size // UNIT), (1 << 32) - 1).astype("<u4")

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys, and whether documents of different ids hold the key."""
        order = np.argsort(self.keys, kind="stable")
        keys, ids = self.keys[order], self.ids[self.doc[order]]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            return keys, new
        return keys[at], np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys and whether ids differ, ordered by bucket and key, and each one's bucket."""
        keys, twice = self.distinct_keys()
        place = _bucket(keys, buckets)
        order = np.argsort(place, kind="stable")
        return keys[order], twice[order], place[order]

    def shared_runs(self, wanted: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs whose keys have their bit set, and the number of each one's content; of hot keys, each suffix is a run."""
        keys, _, place = self.by_bucket(buckets)
        keep, hot = np.zeros((2, len(keys)), dtype=bool)
        at, ends = _edges(place)
        for a, z in zip(at.tolist(), ends.tolist()):
            bits = wanted.get(int(place[a]))
            if bits is not None:
                keep[a:z], hot[a:z] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8).reshape(2, -1), axis=1, count=z - a)
        self.place = _bucket(self.keys, buckets)
        picked = np.flatnonzero(np.isin(self.keys, keys[keep]))
        split = np.isin(self.keys[picked], keys[hot])
        if split.any():
            # The runs stay in order of position, which is that of ids.
            times = np.where(split, self.count[picked], 1)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            one, picked = np.repeat(split, times), np.repeat(picked, times)
            self.first, self.count = self.first[picked] + nth, np.where(one, 1, self.count[picked])
            self.keys, self.doc, self.place = self.keys[picked], self.doc[picked], self.place[picked]
            hashes = _mixed(run_hashes(self.data, self.first[one], np.full(int(one.sum()), self.length)))
            self.place[one] = _bucket(hashes, buckets)
            picked = np.arange(len(picked))
        return picked, numbered(self.data, self.first[picked], self.count[picked] + self.length - 1)[0]


def _edges(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    if not len(place):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return at, np.append(at[1:], len(place))


def numbered(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each string ``data[first:first + size]``, the same for equal ones, and the index of each number's first.

    Strings of equal hash are compared byte by byte; one that differs from the first of its hash gets a number of its own.
    """
    if not len(first):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    mark = _mixed(run_hashes(data, first, sizes)) ^ sizes.astype(np.uint64)
    _, lead, number = np.unique(mark, return_index=True, return_inverse=True)
    other = lead[number]
    same = sizes == sizes[other]
    copies = np.flatnonzero((other != np.arange(len(first))) & same)
    copies = copies[np.argsort(sizes[copies], kind="stable")]
    at, ends = _edges(sizes[copies])
    for a, z in zip(at.tolist(), ends.tolist()):
        rows = np.lib.stride_tricks.sliding_window_view(data, int(sizes[copies[a]]))
        for k in range(a, z, 32768):
            some = copies[k:min(k + 32768, z)]
            same[some] = (rows[first[some]] == rows[first[other[some]]]).all(axis=1)
    if not same.all():
        odd = np.flatnonzero(~same)
        number[odd] = len(lead) + np.arange(len(odd))
        lead = np.concatenate([lead, odd])
    return number, lead


def _packed_keys(keys: np.ndarray) -> bytes:
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES:].tobytes()


def _unpacked_keys(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // KEY_BYTES, 8), dtype=np.uint8)
    wide[:, 8 - KEY_BYTES:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, KEY_BYTES)
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def _cut(keys: np.ndarray) -> np.ndarray:
    """The part of a key that step 1 sends."""
    return keys & _u64((1 << 8 * KEY_BYTES) - 1)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """From the low bits that step 1 sends, so that step 1 and step 3 agree."""
    return ((_cut(keys) * _u64(0xD6E8FEB86659FD93)) >> _u64(16)) % _u64(buckets)


_KEYS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary()), ("units", pa.binary())])
_WANTED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
_RUNS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("numbers", pa.binary()), ("ids", pa.binary()),
                   ("keys", pa.binary()), ("counts", pa.binary()), ("text", pa.binary())])
_MARKS = pa.schema([("block", pa.int64()), ("numbers", pa.binary()), ("marks", pa.binary())])
_DONE = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _squeezed(data: np.ndarray | bytes) -> bytes:
    return zlib.compress(data if isinstance(data, bytes) else data.tobytes(), 1)


def _freed(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x.as_py()), dtype=kind) for x in column]


def _list_keys(length: int, gram: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        block = Block(group, length, gram)
        keys, twice, place = block.by_bucket(buckets)
        units = block.units(keys)
        at, ends = _edges(place)
        number = group.column("block")[0].as_py()
        return pa.table([[number] * len(at), place[at].astype(np.int64), [_packed_keys(_cut(keys[a:z])) for a, z in zip(at, ends)],
                         [np.packbits(twice[a:z]).tobytes() for a, z in zip(at, ends)],
                         [_squeezed(units[a:z]) for a, z in zip(at, ends)]], schema=_KEYS)
    return run


def _shared_keys(hot_bytes: int):
    """To each block two bits for each key that it sent to this bucket: whether it is shared, and whether it is hot too."""
    def run(group: pa.Table) -> pa.Table:
        keys = [_unpacked_keys(k.as_py()) for k in group.column("keys")]
        twice = [np.unpackbits(np.frombuffer(t.as_py(), dtype=np.uint8), count=len(k)).astype(bool) for t, k in zip(group.column("twice"), keys)]
        _, number, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[number[np.concatenate(twice)]] = True
        units = np.bincount(number, weights=np.concatenate(_freed(group.column("units"), "<u4")))
        hot = shared & (units * UNIT > hot_bytes)
        bits, at = [], 0
        for own in keys:
            mine = number[at:at + len(own)]
            bits.append(np.packbits(np.stack([shared[mine], hot[mine]]), axis=1).tobytes())
            at += len(own)
        return pa.table([group.column("block"), group.column("bucket"), bits], schema=_WANTED)
    return run


def _bits_by_bucket(wanted: pa.Table) -> dict[int, bytes]:
    return {k: b for k, b in zip(wanted.column("bucket").to_pylist(), wanted.column("bits").to_pylist()) if b is not None}


def _send_runs(length: int, gram: int, buckets: int):
    def run(key, texts: pa.Table, wanted: pa.Table) -> pa.Table:
        if not texts.num_rows or not wanted.num_rows:
            return _RUNS.empty_table()
        block = Block(texts, length, gram)
        picked, number = block.shared_runs(_bits_by_bucket(wanted), buckets)
        # Runs are in order of id, and np.unique gives the first of each number: the holder of smallest id.
        numbers, first = np.unique(number, return_index=True)
        lead = picked[first]
        place = block.place[lead]
        order = np.argsort(place, kind="stable")
        rows: dict[str, list] = {f.name: [] for f in _RUNS}
        for a, z in zip(*_edges(place[order])):
            own = lead[order[a:z]]
            rows["block"].append(key[0].as_py())
            rows["bucket"].append(int(place[order[a]]))
            rows["numbers"].append(_squeezed(np.diff(numbers[order[a:z]], prepend=0).astype("<u4")))  # they ascend
            rows["ids"].append(_squeezed(block.ids[block.doc[own]].astype("<i8")))
            rows["keys"].append(block.keys[own].astype("<u4").tobytes())  # enough to keep the sort's groups small
            rows["counts"].append(_squeezed(block.count[own].astype("u1")))
            rows["text"].append(_squeezed(b"".join([block.data[s:s + n].tobytes() for s, n in
                                                    zip(block.first[own].tolist(), (block.count[own] + length - 1).tolist())])))
        return pa.table([rows[f.name] for f in _RUNS], schema=_RUNS)
    return run


# --- the suffix sort -------------------------------------------------------------------------------------------------

def common_length(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common start of suffixes ``a`` and ``b``, at most ``most``: binary search on equal prefix hashes."""
    low = np.zeros(len(a), dtype=np.int64)
    high = np.full(len(a), most, dtype=np.int64)
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(a, middle) == hashes.of(b, middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    return low


def heads(data: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """The first bytes of each suffix, eight at most, as a number that sorts like them."""
    out = np.zeros(len(suffixes), dtype=np.uint64)
    for k in range(min(8, most)):
        out = (out << _u64(8)) | data[suffixes + k]
    return out


def less(hashes: PrefixHashes, data: np.ndarray, a: np.ndarray, b: np.ndarray, head_a: np.ndarray, head_b: np.ndarray, most: int,
         or_equal: np.ndarray) -> np.ndarray:
    """Whether suffix ``a`` sorts before ``b`` by their first ``most`` bytes; ``or_equal``: ties count as before.

    Where the first bytes differ, they decide; else the length of the common start tells which bytes do.
    """
    out = head_a < head_b
    open_ = np.flatnonzero(head_a == head_b)
    if len(open_):
        x, y = a[open_], b[open_]
        same = common_length(hashes, x, y, most)
        reach = np.minimum(same, most - 1)
        out[open_] = np.where(same == most, or_equal[open_], data[x + reach] < data[y + reach])
    return out


def merge_sort(hashes: PrefixHashes, data: np.ndarray, suffixes: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of ``suffixes`` by their first ``most`` bytes within each group (``group`` is sorted).

    A bottom-up mergesort over all groups at once: an element's place after a merge is its place in its own run plus the
    number of elements of the sibling run before it, which a binary search finds.
    """
    n = len(suffixes)
    current = np.arange(n)
    if n < 2:
        return current
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begins, n))
    begin, total = np.repeat(begins, size), np.repeat(size, size)
    place = np.arange(n) - begin
    head = heads(data, suffixes, most)
    width = 1
    while width < size.max():
        moving = np.flatnonzero(total > width)
        at, base, own = place[moving], begin[moving], total[moving]
        run = at // width
        right = (run & 1).astype(bool)
        sibling = np.where(right, run - 1, run + 1) * width
        lo = np.minimum(sibling, own)
        hi = np.minimum(sibling + width, own)
        start = lo.copy()
        mine = current[moving]
        active = np.flatnonzero(lo < hi)
        while len(active):
            middle = (lo[active] + hi[active]) // 2
            other = current[base[active] + middle]
            # Elements of the left run go before equal ones of the right run.
            before = less(hashes, data, suffixes[other], suffixes[mine[active]], head[other], head[mine[active]], most, right[active])
            lo[active] = np.where(before, middle + 1, lo[active])
            hi[active] = np.where(before, hi[active], middle)
            active = active[lo[active] < hi[active]]
        target = base + (np.where(right, run - 1, run) * width) + (at - run * width) + (lo - start)
        merged = current.copy()
        merged[target] = mine
        current = merged
        width *= 2
    return current


def classes(data: np.ndarray, hashes: PrefixHashes, index: np.ndarray, suffixes: np.ndarray, group: np.ndarray,
            length: int) -> tuple[np.ndarray, np.ndarray]:
    """``index`` in order of the suffixes, and each one's class: equal first ``length`` bytes, compared byte by byte."""
    place = merge_sort(hashes, data, suffixes, group, length)
    order = suffixes[place]
    rows = np.lib.stride_tricks.sliding_window_view(data, length)
    by_hash = np.zeros(len(order), dtype=bool)
    by_hash[1:] = hashes.of(order[1:], length) == hashes.of(order[:-1], length)
    same = np.zeros(len(order), dtype=bool)
    pairs = np.flatnonzero(by_hash)
    for at in range(0, len(pairs), 32768):
        some = pairs[at:at + 32768]
        same[some] = (rows[order[some]] == rows[order[some - 1]]).all(axis=1)
    if (by_hash != same).any():  # a collision may have misled the sort: sort these suffixes by their bytes
        _, number = np.unique(np.ascontiguousarray(rows[suffixes]).view(f"V{length}").ravel(), return_inverse=True)
        again = np.argsort(number, kind="stable")
        return index[again], number[again]
    return index[place], np.cumsum(~same) - 1


def mark_suffixes(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """For each run (rows) and suffix (columns): whether a run of smaller id holds an equal string."""
    # Equal runs of several blocks are one, held by the smallest id; other holders lose all of it.
    number, lead = numbered(data, starts, counts + length - 1)
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    owner = np.repeat(np.arange(len(lead)), counts[lead])
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts[lead]) - counts[lead], counts[lead])
    suffix = starts[lead][owner] + nth
    # A suffix whose hash no other one has is alone in its class; the sort need not see it.
    hashes = PrefixHashes(data)
    marks = hashes.of(suffix, length)
    order = np.argsort(marks)
    twin = marks[order[1:]] == marks[order[:-1]]
    paired = np.zeros(len(order), dtype=bool)
    paired[order[1:][twin]] = paired[order[:-1][twin]] = True
    left = np.flatnonzero(paired)
    left = left[np.argsort(keys[lead][owner[left]], kind="stable")]
    bits = np.zeros((len(lead), RUN), dtype=bool)
    if len(left):
        order, number_of = classes(data, hashes, np.arange(len(left)), suffix[left], keys[lead][owner[left]], length)
        which = left[order]
        holder = least[owner[which]]
        smallest = np.full(number_of.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, number_of, holder)
        gone = which[holder > smallest[number_of]]
        bits[owner[gone], nth[gone]] = True
    return bits[number] | (ids > least[number])[:, None]


def _mark_runs(length: int):
    def run(group: pa.Table) -> pa.Table:
        per_block = _freed(group.column("counts"), "u1")
        counts = np.concatenate(per_block).astype(np.int64)
        ids = np.concatenate(_freed(group.column("ids"), "<i8"))
        keys = np.concatenate([np.frombuffer(k.as_py(), dtype="<u4") for k in group.column("keys")])
        data = np.concatenate(_freed(group.column("text"), "u1"))
        sizes = counts + length - 1
        marks = np.packbits(mark_suffixes(data, np.cumsum(sizes) - sizes, counts, ids, keys, length), axis=1)
        out, at = [], 0
        for own in per_block:
            out.append(_squeezed(marks[at:at + len(own)]))
            at += len(own)
        return pa.table([group.column("block"), group.column("numbers"), out], schema=_MARKS)
    return run


def _removed(block: Block, sides: pa.Table, buckets: int) -> np.ndarray | None:
    """Which bytes of the block go, if any."""
    length = block.length
    picked, number = block.shared_runs(_bits_by_bucket(sides), buckets)
    if not len(picked):
        return None
    bits = np.zeros((int(number.max()) + 1, RUN), dtype=bool)
    marked = sides.filter(pc.is_valid(sides.column("marks")))
    for steps, marks in zip(_freed(marked.column("numbers"), "<u4"), _freed(marked.column("marks"), "u1")):
        bits[np.cumsum(steps, dtype=np.int64)] = np.unpackbits(marks.reshape(len(steps), RUN // 8), axis=1).astype(bool)
    # In documents after the first holder in this block the whole run goes.
    _, first = np.unique(number, return_index=True)
    lead = np.zeros(len(bits), dtype=np.int64)
    lead[number[first]] = block.ids[block.doc[picked[first]]]
    own = bits[number] | (block.ids[block.doc[picked]] > lead[number])[:, None]
    own &= np.arange(RUN) < block.count[picked][:, None]
    which, nth = np.nonzero(own)
    at = block.first[picked][which] + nth
    change = np.bincount(at, minlength=len(block.data) + 1).astype(np.int32)
    change -= np.bincount(at + length, minlength=len(block.data) + 1).astype(np.int32)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _remove(length: int, gram: int, buckets: int):
    """``sides``: the wanted keys, which number the contents again, and the marks by number."""
    def run(key, texts: pa.Table, sides: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _DONE.empty_table()
        block = Block(texts, length, gram)
        gone = _removed(block, sides, buckets) if sides.num_rows else None
        spans, kept = [], []
        for text, a, z in zip(block.texts, block.starts[:-1].tolist(), block.starts[1:].tolist()):
            if gone is None or not gone[a:z].any():
                spans.append([])
                kept.append(text)
            else:
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:z], [False]]).astype(np.int8)))
                spans.append([{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()])
                kept.append(block.data[a:z][~gone[a:z]].tobytes())
        return pa.table([block.ids, [len(t) for t in block.texts], spans, kept], schema=_DONE)
    return run


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 24, block_bytes: int = BLOCK_BYTES,
                   hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(id, n_bytes, spans, kept) per row: removed byte ranges [start, end) in order, and the bytes that stay."""
    if not 0 < gram <= length:
        raise ValueError("gram must lie between 1 and length")
    texts = keyed_texts(docs)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    listed = dealt.groupBy("block").applyInArrow(
        _list_keys(length, gram, blocks), "block long, bucket long, keys binary, twice binary, units binary")
    wanted = listed.groupBy("bucket").applyInArrow(_shared_keys(hot_bytes), "block long, bucket long, bits binary")
    runs = dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(
        _send_runs(length, gram, blocks), "block long, bucket long, numbers binary, ids binary, keys binary, counts binary, text binary")
    marks = runs.groupBy("bucket").applyInArrow(_mark_runs(length), "block long, numbers binary, marks binary")
    none = F.lit(None).cast("binary")
    sides = wanted.select("block", "bucket", "bits", none.alias("numbers"), none.alias("marks")).unionByName(
        marks.select("block", F.lit(None).cast("long").alias("bucket"), none.alias("bits"), "numbers", "marks"))
    return dealt.groupBy("block").cogroup(sides.groupBy("block")).applyInArrow(
        _remove(length, gram, blocks), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def substring_dedup_report(docs: DataFrame) -> DataFrame:
    """The digest columns of query op2."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return repeated_spans(docs).select(given_id(), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                                       F.sha2("kept", 256).alias("kept_sha256"))
