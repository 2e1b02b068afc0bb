"""Benchmark decontamination: one Aho-Corasick automaton over windows of test items, each text scanned once.

Texts and items are normalised alike: A-Z lower-cased, words are runs of digits, letters and characters beyond ASCII,
all else separates. A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
window. A word of a text is hit if it lies inside any occurrence of a window.

Edge cases: a null or empty text has no words; a null or empty item has no windows; items without an id are matched but
not listed; equal items are all listed; a repeated row gives a repeated result; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.base import WORD_BYTES, carried, char_offsets, record, restored, text_bytes, word_bytes

#: Bytes of item text that one automaton holds. Windows overlap, so its trie has up to ``window`` times as many nodes,
#: some 50 bytes each. Larger item tables are cut into blocks of this size.
BLOCK_BYTES = 200_000
#: Bytes of text that are scanned by one automaton before the next is built, where there are several.
GROUP_BYTES = 64 << 20

_FOUND = [("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string())),
          ("spans", pa.list_(pa.list_(pa.int64())))]
_FOUND_DDL = "n_words long, runs array<long>, items array<string>, spans array<array<long>>"


def windows(text: bytes, window: int) -> set[bytes]:
    """Normalised windows of one item, each between blanks."""
    words = word_bytes(text)
    if not words:
        return set()
    return {b" " + b" ".join(words[i:i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def automaton(items: list[tuple[str | None, bytes]], window: int):
    """The automaton: a window's value is its number of words and the ids of the items that hold it."""
    holders: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(text, window):
            holders.setdefault(w, set()).add(item)
    machine = ahocorasick.Automaton()
    for w, ids in holders.items():
        machine.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(x for x in ids if x is not None)))
    if holders:
        machine.make_automaton()
    return machine


@lru_cache(maxsize=1)
def _shared_automaton(blocks: Broadcast, k: int, window: int):
    """That of block ``k``; a Python worker keeps the last one."""
    return automaton(blocks.value[k], window)


def scan(machine, text: bytes, known: list[int] = ()) -> tuple[int, np.ndarray, set[str], np.ndarray]:
    """Number of words, first and last word of each maximal hit run, items found, and the runs as byte offsets of ``text``.

    ``known``: first, last, first, last, ... of runs found before, which are united with the new ones.
    """
    spaced = text.translate(WORD_BYTES)
    words = spaced.split()
    none = np.empty((0, 2), dtype=np.int64)
    found = []
    if words and len(machine):
        line = b" " + b" ".join(words) + b" "
        found = list(machine.iter(line.decode("latin-1")))
    if not found and not len(known):
        return len(words), none, set(), none
    change = np.zeros(len(words) + 1, dtype=np.int64)
    if found:
        blanks = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
        ends = np.searchsorted(blanks, np.array([end for end, _ in found]))  # a match ends at the blank after its last word
        np.add.at(change, ends - np.array([value[0] for _, value in found]), 1)
        np.add.at(change, ends, -1)
    np.add.at(change, np.array(known[0::2], dtype=np.int64), 1)
    np.add.at(change, np.array(known[1::2], dtype=np.int64) + 1, -1)
    edges = np.flatnonzero(np.diff((np.cumsum(np.concatenate([[0], change])) > 0).astype(np.int8)))
    runs = np.stack([edges[::2], edges[1::2] - 1], axis=1)
    # Lower-casing and blanking keep every byte in its place, so word k starts in the original where it starts here.
    step = np.diff(np.concatenate([[0], np.frombuffer(spaced, dtype=np.uint8) != 32, [0]]).astype(np.int8))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return len(words), runs, {i for _, value in found for i in value[1]}, np.stack([starts[runs[:, 0]], stops[runs[:, 1]]], axis=1)


def _gathered(batches, size: int):
    """Lists of batches of about ``size`` bytes of text."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column("text").nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _scanner(blocks: Broadcast, n_blocks: int, window: int):
    def run(batches):
        # One block needs no gathering. With several, each machine is built once for many texts.
        for group in _gathered(batches, 1 if n_blocks == 1 else GROUP_BYTES):
            found = [[(0, np.empty((0, 2), dtype=np.int64), set(), np.empty((0, 2), dtype=np.int64))] * b.num_rows for b in group]
            for k in range(n_blocks):
                machine = _shared_automaton(blocks, k, window)
                for batch, own in zip(group, found):
                    for i, text in enumerate(text_bytes(batch.column("text"))):
                        _, runs, ids, _ = own[i]
                        n, runs, more, places = scan(machine, text, runs.ravel().tolist())
                        own[i] = (n, runs, ids | more, places)
            for batch, own in zip(group, found):
                schema = pa.schema([batch.schema.field("doc"), *_FOUND])
                spans = [char_offsets(text, places).tolist() if len(places) else []
                         for text, (_, _, _, places) in zip(text_bytes(batch.column("text")), own)]
                yield record(schema, doc=batch.column("doc"), n_words=[n for n, _, _, _ in own], runs=[r.ravel().tolist() for _, r, _, _ in own],
                             items=[sorted(ids) for _, _, ids, _ in own], spans=spans)
    return run


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: the row as struct ``doc``, n_words, n_hit, ids of items found, hit spans as code-point offsets [start, end).

    ``docs``: doc_id, text. ``items``: item_id, text. Texts are read once and not shuffled. Up to ``block_bytes`` of items go
    into one automaton. More are cut into blocks, and each part of the texts is scanned by the blocks' automata in turn
    before the next is read, so a worker holds one automaton and :data:`GROUP_BYTES` of texts.
    """
    spark = docs.sparkSession
    blocks: list[list[tuple[str | None, bytes]]] = [[]]
    size = 0
    texts = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    for item in sorted(((r.item, bytes(r.text)) for r in texts.collect()), key=str):
        if size >= block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append(item)
        size += len(item[1])
    carried_docs = carried(docs)
    schema = T.StructType([T.StructField("doc", carried_docs.schema["doc"].dataType), *T.StructType.fromDDL(_FOUND_DDL)])
    found = carried_docs.mapInArrow(_scanner(spark.sparkContext.broadcast(blocks), len(blocks), window), schema)
    n_hit = F.aggregate(F.transform("spans", lambda s, i: F.get("runs", 2 * i + 1) - F.get("runs", 2 * i) + 1), F.lit(0).cast("long"),
                        lambda a, n: a + n)
    return found.select("doc", "n_words", n_hit.alias("n_hit"), "items", "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item; columns as they were."""
    return restored(find_contamination(docs, items, window).filter(F.col("n_hit") == 0), docs)


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of query op1."""
    return find_contamination(docs.select("doc_id", "text"), items).select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
with cut as (
  select 'd' as side, row_number() over () as r, doc_id as id, cast(null as varchar) as item, coalesce(text, '') as text from documents
  union all
  select 'b', row_number() over (), null, cast(item_id as varchar), coalesce(text, '') from benchmark
), worded as (
  select side, r, id, item, list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from cut
), item_windows as (
  select distinct item, least(len(words), 10) as size, unnest(list_transform(range(greatest(len(words) - 9, 1)),
           lambda i: array_to_string(list_slice(words, i + 1, i + 10), ' '))) as part
  from worded where side = 'b' and len(words) > 0
), sizes as (select distinct size from item_windows
), places as (
  select r, size, unnest(range(len(words) - size + 1)) as pos, unnest(list_transform(range(len(words) - size + 1),
           lambda i: array_to_string(list_slice(words, i + 1, i + size), ' '))) as part
  from worded, sizes where side = 'd' and len(words) >= size
), found as (select p.r, p.pos, p.size, w.item from places p join item_windows w on p.part = w.part and p.size = w.size
), hit as (select r, count(distinct word) as n_hit from (select r, unnest(range(pos, pos + size)) as word from found) group by r
), listed as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from found where item is not null) group by r
)
select d.id as doc_id, cast(len(d.words) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(l.n_items, 0) as n_items,
       sha256(coalesce(l.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from worded d left join hit h on d.r = h.r left join listed l on d.r = l.r where d.side = 'd'
"""
