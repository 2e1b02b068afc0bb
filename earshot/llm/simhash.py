"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's fingerprint has bit b set if more than half of its shingles' hashes have it set. Fingerprints of at most
``radius`` differing bits are linked: then some value lies within ``radius / 2`` of both, so every fingerprint emits all
variants within half the radius, and two fingerprints that emit the same value are a pair. Within one value all
fingerprints lie within ``radius`` of each other, so linking each to the smallest is enough, and no group's pairs are
written out.

2,081 variants a fingerprint (radius 4) are far more than a row each can carry. So:

1. distinct fingerprints are dealt into ``block``s; a block sends, per ``bucket`` of the mixed variant, the sorted
   distinct mixed variants, cut to a few bits more than tell the variants apart, as low bits and a unary-coded rest
   (Elias-Fano), about 2.5 bytes each;
2. a bucket answers each block with those of its values that another block sent too;
3. a block links its own fingerprints that share a variant, and sends the whole variant and its fingerprint for each
   value that came back;
4. a bucket verifies the pairs that share a whole variant by their differing bits and links the blocks' components.

Components come from alternating large-star and small-star steps over the links, written to the shared folder between;
a step that the next has replaced is removed.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other; a text of
fewer words than a shingle has one shingle; repeated rows are repeated; null ids count as the smallest and the component
of such a row is null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.base import NULL_ID, Steps, carried, given_id, keyed_texts, materialize, record, restored, text_bytes

SEED = 42
#: Fingerprints in a block: their variants are held at once.
BLOCK_PRINTS = 2048
#: Partitions that blocks are dealt into at most; beyond it a partition holds several blocks, one after the other.
MOST_PARTITIONS = 20_000
#: Bits of a mixed variant beyond those that number all variants: one value in 2^SPARE coincides for nothing.
SPARE = 10

_PRINTS = pa.schema([("id", pa.int64()), ("print", pa.int64())])


# --- fingerprints ----------------------------------------------------------------------------------------------------

def shingle_hashes(text: bytes, words_in: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    words = text.lower().split()  # of bytes, lower() changes A-Z only and split() cuts at \x20\x09-\x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_in:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - words_in + 1
    return np.fromiter((digest(line[a:z], SEED) for a, z in zip(starts[:n].tolist(), ends[words_in - 1:].tolist())), dtype=np.uint64, count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, as a number of 64 bits."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_in: int = 4) -> DataFrame:
    """(id, print): fingerprints as signed longs."""
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(t, words_in)) for t in text_bytes(batch.column("text"))], dtype=np.uint64)
            yield record(_PRINTS, id=batch.column("id"), print=prints.view(np.int64))
    return keyed_texts(docs).mapInArrow(run, "id long, print long")


# --- variants --------------------------------------------------------------------------------------------------------

def masks(half: int) -> np.ndarray:
    """All 64-bit values of at most ``half`` set bits."""
    found = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return np.array(found, dtype=np.uint64)


def _mixed(v: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    v = v ^ (v >> np.uint64(33))
    v *= np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    v ^= v >> np.uint64(33)
    return v


def pack(sorted_values: np.ndarray, low_bits: int) -> bytes:
    """Ascending distinct values: a count and the number of low bytes, low bytes of each, the rest unary as gaps."""
    n, wide = len(sorted_values), (low_bits + 7) // 8
    low = (sorted_values & np.uint64((1 << 8 * wide) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
    high = (sorted_values >> np.uint64(8 * wide)).astype(np.int64)
    base = int(high[0]) if n else 0
    bits = np.zeros(int(high[-1]) - base + n if n else 0, dtype=bool)
    bits[high - base + np.arange(n)] = True
    return np.array([n, wide, base], dtype="<i8").tobytes() + low.tobytes() + np.packbits(bits).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, wide, base = np.frombuffer(data[:24], dtype="<i8").tolist()
    low = np.zeros((n, 8), dtype=np.uint8)
    low[:, :wide] = np.frombuffer(data, dtype=np.uint8, offset=24, count=n * wide).reshape(n, wide)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=24 + n * wide))
    high = np.flatnonzero(bits)[:n] - np.arange(n) + base
    return (high.astype(np.uint64) << np.uint64(8 * wide)) | low.view("<u8").reshape(-1)


class Balls:
    """How variants are cut and dealt: the top bits of the mixed variant are its bucket, the next ``bits`` its value."""

    def __init__(self, half: int, blocks: int, prints: int):
        self.masks = masks(half)
        # A power of two of buckets, about as many as blocks.
        self.bucket_bits = max(0, blocks - 1).bit_length()
        variants = max(1, prints) * len(self.masks)
        self.bits = min(64 - self.bucket_bits, max(16, variants.bit_length() + SPARE - self.bucket_bits))
        # Gaps of the values of one block in one bucket, in bits.
        inside = max(1, min(prints, BLOCK_PRINTS) * len(self.masks) >> self.bucket_bits)
        self.low_bits = max(8, self.bits - inside.bit_length())

    def values(self, prints: np.ndarray) -> np.ndarray:
        """Bucket and value in one number, for each print (rows) and variant (columns)."""
        mixed = _mixed(prints.view(np.uint64)[:, None] ^ self.masks[None, :])
        return mixed >> np.uint64(64 - self.bucket_bits - self.bits)


_VALUES = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("packed", pa.binary())])
_EMITTED = pa.schema([("bucket", pa.int64()), ("variants", pa.binary()), ("emitter", pa.binary()), ("prints", pa.binary()),
                      ("roots", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _prints_of(table: pa.Table) -> np.ndarray:
    return np.sort(np.array(table.column("print").to_pylist(), dtype=np.int64))


def _send_values(balls: Balls):
    def run(group: pa.Table) -> pa.Table:
        values = balls.values(_prints_of(group)).ravel()
        values.sort()
        values = values[np.concatenate([[True], values[1:] != values[:-1]])]
        places = np.arange((1 << balls.bucket_bits) + 1, dtype=object)
        edges = np.searchsorted(values, np.array([min(int(p) << balls.bits, (1 << 64) - 1) for p in places], dtype=np.uint64))
        edges[-1] = len(values)
        low = np.uint64((1 << balls.bits) - 1)
        rows = [(p, pack(values[a:z] & low, balls.low_bits)) for p, (a, z) in enumerate(zip(edges[:-1], edges[1:])) if a < z]
        block = group.column("block")[0].as_py()
        return pa.table([[block] * len(rows), [r[0] for r in rows], [r[1] for r in rows]], schema=_VALUES)
    return run


def _return_shared(balls: Balls):
    def run(group: pa.Table) -> pa.Table:
        blocks, packed = group.column("block").to_pylist(), group.column("packed")
        parts = [unpack(x.as_py()) for x in packed]
        every = np.concatenate(parts)
        every.sort()
        shared = every[1:][every[1:] == every[:-1]]
        bucket = group.column("bucket")[0].as_py()
        rows = []
        if len(shared):
            shared = shared[np.concatenate([[True], shared[1:] != shared[:-1]])]
            for block, own in zip(blocks, parts):
                hit = own[np.isin(own, shared, assume_unique=True)]
                if len(hit):
                    rows.append((block, pack(hit, balls.low_bits)))
        return pa.table([[r[0] for r in rows], [bucket] * len(rows), [r[1] for r in rows]], schema=_VALUES)
    return run


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the links a - b, for each of ``n`` nodes."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return root


def _emit_shared(balls: Balls, radius: int):
    """For each bucket: variants that another block may have too, who emits each, and these prints' roots in this block.

    In bucket -1 all prints that are not their own root, as links.
    """
    def run(key, prints_table: pa.Table, shared_table: pa.Table) -> pa.Table:
        if not prints_table.num_rows:
            return _EMITTED.empty_table()
        prints = _prints_of(prints_table)
        values = balls.values(prints)
        width = values.shape[1]
        order = np.argsort(values, axis=None, kind="stable")
        ordered = values.ravel()[order]
        del values
        twin = ordered[1:] == ordered[:-1]
        wanted = np.empty(0, dtype=np.uint64)
        if shared_table.num_rows:
            wanted = np.sort(np.concatenate([unpack(p.as_py()) | (np.uint64(k.as_py()) << np.uint64(balls.bits)) for k, p in
                                             zip(shared_table.column("bucket"), shared_table.column("packed"))]))
        keep = np.zeros(len(ordered), dtype=bool)
        keep[1:] |= twin
        keep[:-1] |= twin
        if len(wanted):
            at = np.searchsorted(ordered, wanted)
            last = np.searchsorted(ordered, wanted, side="right")
            change = np.zeros(len(ordered) + 1, dtype=np.int32)
            np.add.at(change, at, 1)
            np.add.at(change, last, -1)
            asked = np.cumsum(change[:-1]) > 0
            keep |= asked
        else:
            asked = np.zeros(len(ordered), dtype=bool)
        left = np.flatnonzero(keep)
        owner = order[left] // width
        variant = prints.view(np.uint64)[owner] ^ balls.masks[order[left] % width]
        bucket = (ordered[left] >> np.uint64(balls.bits)).astype(np.int64)
        asked = asked[left]
        again = np.lexsort((owner, variant, bucket))
        owner, variant, bucket, asked = owner[again], variant[again], bucket[again], asked[again]
        pair = np.flatnonzero(variant[1:] == variant[:-1])
        a, b = owner[pair], owner[pair + 1]
        close = np.bitwise_count(prints.view(np.uint64)[a] ^ prints.view(np.uint64)[b]) <= radius
        root = local_roots(len(prints), a[close], b[close])
        rows: list[tuple] = []
        inner = np.flatnonzero(root != np.arange(len(prints)))
        if len(inner):
            rows.append((-1, b"", b"", prints[inner].tobytes(), prints[root[inner]].tobytes()))
        # One print stands for all of a variant: those of one block are linked already.
        first = np.concatenate([[True], variant[1:] != variant[:-1]]) & asked if len(variant) else asked
        owner, variant, bucket = owner[first], variant[first], bucket[first]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for x, z in zip(edges, np.append(edges[1:], len(bucket))):
            names, index = np.unique(owner[x:z], return_inverse=True)
            rows.append((int(bucket[x]), variant[x:z].tobytes(), index.astype("<u4").tobytes(), prints[names].tobytes(),
                         prints[root[names]].tobytes()))
        return pa.table([[r[i] for r in rows] for i in range(5)], schema=_EMITTED)
    return run


def _link_blocks(radius: int):
    def run(group: pa.Table) -> pa.Table:
        def all_of(name, kind):
            return [np.frombuffer(x, dtype=kind) for x in group.column(name).to_pylist()]
        prints, roots = all_of("prints", "<i8"), all_of("roots", "<i8")
        if group.column("bucket")[0].as_py() < 0:
            return pa.table([np.concatenate(roots), np.concatenate(prints)], schema=_LINKS)
        variants, emitters = all_of("variants", "<u8"), all_of("emitter", "<u4")
        variant = np.concatenate(variants)
        sender = np.concatenate([p[e] for p, e in zip(prints, emitters)])
        root = np.concatenate([r[e] for r, e in zip(roots, emitters)])
        order = np.argsort(variant, kind="stable")
        variant, sender, root = variant[order], sender[order], root[order]
        pair = np.flatnonzero(variant[1:] == variant[:-1])
        pair = pair[np.bitwise_count(sender[pair].view(np.uint64) ^ sender[pair + 1].view(np.uint64)) <= radius]
        links = np.unique(np.stack([root[pair], root[pair + 1]], axis=1), axis=0)
        return pa.table([links[:, 0], links[:, 1]], schema=_LINKS)
    return run


def print_links(prints: DataFrame, radius: int = 4, block_prints: int = BLOCK_PRINTS) -> DataFrame:
    """(a, b): links that connect all ``print``s of a component; ``prints`` holds distinct values.

    ``radius`` is even: then all prints of a variant lie within the radius of each other, and neighbours stand for all.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    n = prints.count()
    blocks = max(1, -(-n // block_prints))
    balls = Balls(radius // 2, blocks, n)
    # A row is eight bytes, its variants seventeen thousand: partitions by blocks, not by the bytes of their rows.
    dealt = (prints.select("print", F.pmod(F.xxhash64("print"), F.lit(blocks)).alias("block"))
             .repartition(min(blocks, MOST_PARTITIONS), "block"))
    sent = dealt.groupBy("block").applyInArrow(_send_values(balls), "block long, bucket long, packed binary")
    shared = sent.groupBy("bucket").applyInArrow(_return_shared(balls), "block long, bucket long, packed binary")
    emitted = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        _emit_shared(balls, radius), "bucket long, variants binary, emitter binary, prints binary, roots binary")
    # The links inside blocks are dealt by themselves, else they would meet in one group.
    part = F.when(F.col("bucket") < 0, F.xxhash64("prints")).otherwise(0).alias("part")
    return emitted.groupBy("bucket", part).applyInArrow(_link_blocks(radius), "a long, b long")


# --- components ------------------------------------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node with a link.

    Large-star links each node's larger neighbours to its smallest one, small-star its smaller ones; they alternate until
    nothing changes. A node's neighbours are never gathered: their minimum is aggregated map-side and joined back.
    """
    steps = Steps(links.sparkSession, "links")
    edges = steps.write(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                        .filter(F.col("u") != F.col("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(least, "v").filter(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
                                                F.struct(F.col("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        edges = steps.write(small.filter(F.col("u") != F.col("v")).distinct())
        # Sums of hashes tell whether a step changed the set of links.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, words_in: int = 4, radius: int = 4) -> DataFrame:
    """(id, print, component): each row's fingerprint and the smallest id linked to it, directly or not."""
    prints = materialize(fingerprints(docs, words_in), "simhash")
    return grouped(prints, print_links(prints.select("print").distinct(), radius))


def grouped(prints: DataFrame, links: DataFrame) -> DataFrame:
    """(id, print, component): each row of ``prints`` and the smallest id that ``links`` between prints connect it to."""
    distinct = prints.groupBy("print").agg(F.min("id").alias("least"))
    roots = components(links)
    classes = distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(classes.select("print", "root").join(smallest, "root").select("print", "component"), "print")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """The digest columns of query op7."""
    return near_duplicates(docs).select(
        given_id(), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"))


def keep_first_of_group(docs: DataFrame, words_in: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest id; of rows that repeat this id, one."""
    return keep_smallest(docs, near_duplicates(docs.select("doc_id", "text"), words_in, radius))


def keep_smallest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``found``, that of the smallest id; of rows that repeat this id, one."""
    kept = found.filter(F.col("id") == F.col("component")).select("id").distinct()
    rows = carried(docs).select("doc", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(NULL_ID)).alias("id"))
    stay = rows.join(kept, "id", "left_semi")
    # The join has dealt the rows by id already, so this window shuffles nothing; an id has as many rows as it is repeated.
    first = stay.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("id"))).filter("nth = 1")
    return restored(first, docs)
