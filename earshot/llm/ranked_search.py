"""Ranked lexical search by the Best Position Algorithm over impact lists.

A term's impact in a document is a whole number: its weight times the saturated, length-normalised frequency. The score of
a document for an item is the sum of the impacts of the item's distinct terms.

1. One pass over the texts keeps, per document, its number of terms and the frequencies of the item terms; this table is
   written. Number of documents, total length and document frequencies are sums over all of it.
2. Documents are taken in blocks of bounded size, as they lie. In a block each term has a list of its documents in
   descending order of impact. For an item the lists are read downwards together; each new document is completed by direct
   access to its places in all other lists. Every place that was seen either way is marked, and a list's best position is
   the end of the run of marked places from its top. A document that was not seen lies beyond all best positions, so the
   impacts there bound its score; the search stops when their sum is strictly below the k-th score, as an equal score
   with a smaller id would still change the ranking. Last-read positions would bound it more loosely.
3. A task keeps each item's best k over all its blocks, so a later block stops the sooner, and hands on k rows an item.
   The best k of all tasks are picked in two steps, first in salted groups.

Search is exact: what lies beyond the stop cannot enter the ranking, and nothing else is left out.

Items are collected in blocks of ``ITEM_BYTES`` of text, which bounds what is sent to the tasks; each block of items is one
search over all documents. Hot terms: a list never leaves its block of documents.

Edge cases: a null text has no terms; documents without terms do not count; rows that repeat an id are documents of their
own, and every row of the items is an item of its own; null ids count as the smallest; an item without terms, or whose
terms no document holds, has no rows; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.base import given_id, keyed_texts, materialize, record, text_bytes, word_bytes

#: Bytes of item texts that are searched at once.
ITEM_BYTES = 16 << 20
#: Postings of a block of documents, at least; a block ends with the document that reaches it.
BLOCK_POSTINGS = 1 << 20
#: Places of each list that the first step of a search reads; every further step reads twice as many.
FIRST_STEP = 8
#: Documents completed at once have so many places to look up, about.
LOOKUPS = 1 << 20
#: Groups in which the tasks' rankings meet first.
SALTS = 256

_POSTINGS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])
_HELD = pa.schema([("term", pa.int64()), ("held", pa.int64())])
_RANKED = pa.schema([("item", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


# --- one block of documents ------------------------------------------------------------------------------------------

class Block:
    """Impact lists of a block, and the places of its documents in them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray,
                 weights: np.ndarray, rows: int, total: int):
        self.ids, self.n_terms, self.weights = ids, len(weights), weights
        doc = np.repeat(np.arange(len(ids)), sizes)
        damp = 10 + 90 * lengths * rows // total
        value = 1_000_000_000 * counts // (1000 * counts + 8 * damp[doc])
        self.impact = weights[terms] * value  # by document, then term
        self.key = doc * self.n_terms + terms  # ascending
        order = np.lexsort((ids[doc], -value, terms))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(self.n_terms + 1))
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))

    def direct(self, docs: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents over the terms, and the places of all their postings."""
        wanted = docs[:, None] * self.n_terms + terms[None, :]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        hit = self.key[at] == wanted
        return np.where(hit, self.impact[at], 0).sum(axis=1), self.place[at[hit]]


class Best:
    """The best ``k`` of one item: highest score first, equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        above = scores >= max(self.kth(), 1)
        ids, scores = np.concatenate([self.ids, ids[above]]), np.concatenate([self.scores, scores[above]])
        first = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[first], scores[first]

    def kth(self) -> int:
        """The k-th score so far, 0 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0


def search(block: Block, terms: np.ndarray, best: Best) -> int:
    """Add the block's best documents for an item's distinct ``terms`` to ``best``; returns how many documents were completed."""
    terms = terms[(block.weights[terms] > 0) & (block.starts[terms + 1] > block.starts[terms])]
    if not len(terms):
        return 0
    starts, ends = block.starts[terms], block.starts[terms + 1]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    # Marks of the item's lists stand one after the other, each with a place behind its end that is never marked.
    shift = offsets[:-1] + np.arange(len(terms)) - starts
    marked = np.zeros(offsets[-1] + len(terms), dtype=bool)
    done = np.zeros(len(block.ids), dtype=bool)
    position = starts.copy()  # the first place of each list that is not marked
    read, step = 0, FIRST_STEP
    while True:
        upto = np.minimum(starts + read + step, ends)
        fresh = np.concatenate([block.list_doc[a:z] for a, z in zip((starts + read).tolist(), upto.tolist()) if a < z] or [np.empty(0, dtype=np.int64)])
        fresh = np.unique(fresh[~done[fresh]])
        done[fresh] = True
        size = max(1, LOOKUPS // len(terms))
        for some in (fresh[i:i + size] for i in range(0, len(fresh), size)):
            scores, places = block.direct(some, terms)
            best.add(block.ids[some], scores)
            marked[places + shift[np.searchsorted(starts, places, side="right") - 1]] = True
        bound = 0
        for i, (at, end) in enumerate(zip(position.tolist(), ends.tolist())):
            if at < end:
                run = marked[at + shift[i]:end + shift[i] + 1]
                at += int(run.argmin())
                position[i] = at
                if at < end:
                    bound += int(block.list_impact[at])
        if bound < best.kth() or not bound:
            return int(done.sum())
        read += step
        step *= 2


# --- over all documents ----------------------------------------------------------------------------------------------

def item_blocks(items: DataFrame, block_bytes: int = ITEM_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items as (id, text) in blocks of about ``block_bytes``; the driver holds one block at a time."""
    held, size = [], 0
    rows = items.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    for row in rows.toLocalIterator():
        held.append((row["item_id"], bytes(row["text"])))
        size += len(row["text"])
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _postings(vocabulary):
    def run(batches):
        known = vocabulary.value
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in text_bytes(batch.column("text")):
                words = word_bytes(text)
                found = sorted((known[w], n) for w, n in Counter(words).items() if w in known)
                lengths.append(len(words))
                terms.append(np.array([t for t, _ in found], dtype="<i4").tobytes())
                counts.append(np.array([n for _, n in found], dtype="<i8").tobytes())
            yield record(_POSTINGS, id=batch.column("id"), n=lengths, terms=terms, counts=counts)
    return run


def _held(size: int):
    def run(batches):
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype="<i4")
            held += np.bincount(terms, minlength=size)
        some = np.flatnonzero(held)
        yield record(_HELD, term=some, held=held[some])
    return run


def _searcher(task, k: int):
    def run(batches):
        item_terms, weights, rows, total = task.value
        best = [Best(k) for _ in item_terms]

        def finish(parts):
            ids, lengths = (np.array([x for p in parts for x in p[i]], dtype=np.int64) for i in range(2))
            terms = np.frombuffer(b"".join(t for p in parts for t in p[2]), dtype="<i4").astype(np.int64)
            counts = np.frombuffer(b"".join(c for p in parts for c in p[3]), dtype="<i8")
            sizes = np.array([len(t) // 4 for p in parts for t in p[2]], dtype=np.int64)
            if len(terms):
                block = Block(ids, lengths, sizes, terms, counts, weights, rows, total)
                for own, found in zip(item_terms, best):
                    search(block, own, found)
        parts, size = [], 0
        for batch in batches:
            part = [batch.column(c).to_pylist() for c in ("id", "n", "terms", "counts")]
            parts.append(part)
            size += sum(map(len, part[2])) // 4
            if size >= BLOCK_POSTINGS:
                finish(parts)
                parts, size = [], 0
        if parts:
            finish(parts)
        some = [i for i, b in enumerate(best) if len(b.ids)]
        if some:
            yield record(_RANKED, item=np.repeat(some, [len(best[i].ids) for i in some]), id=np.concatenate([best[i].ids for i in some]),
                         score=np.concatenate([best[i].scores for i in some]))
    return run


def weight(documents: int, held: int) -> int:
    """A term's weight by the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, id, score): each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    found = None
    for number, block in enumerate(item_blocks(items, block_bytes)):
        words = [sorted(set(word_bytes(text))) for _, text in block]
        known = {w: i for i, w in enumerate(sorted({w for own in words for w in own}))}
        vocabulary = spark.sparkContext.broadcast(known)
        postings = materialize(keyed_texts(docs).mapInArrow(_postings(vocabulary), "id long, n long, terms binary, counts binary"),
                               f"postings-{number}")
        rows, total = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = postings.select("terms").mapInArrow(_held(len(known)), "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
        weights = np.zeros(len(known), dtype=np.int64)
        for term, n in held.collect():  # one number per term of the block of items
            weights[term] = weight(rows, n)
        item_terms = [np.array([known[w] for w in own], dtype=np.int64) for own in words]
        task = spark.sparkContext.broadcast((item_terms, weights, rows, total))
        ranked = postings.mapInArrow(_searcher(task, k), "item long, id long, score long")
        ranked = _top(ranked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), ["item", "salt"], k)
        ranked = _top(ranked.drop("salt", "rank"), ["item"], k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], _names_schema(items))
        own = ranked.join(names, "item").select("item_id", "rank", "id", "score")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found


def _names_schema(items: DataFrame) -> str:
    return f"item long, item_id {items.schema['item_id'].dataType.simpleString()}"


def _top(ranked: DataFrame, group: list[str], k: int) -> DataFrame:
    by = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return ranked.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of query op11."""
    found = best_documents(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), given_id(), "score")


ORACLE_SQL = r"""
with texts as (
  select 'd' as side, row_number() over () as r, doc_id as id, coalesce(text, '') as text from documents
  union all select 'b', row_number() over (), item_id, coalesce(text, '') from benchmark
), terms as (
  select side, r, id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) as term
  from texts
), counted as (select side, r, id, term, count(*) as tf from terms group by all
), lengths as (select r, sum(tf) as n from counted where side = 'd' group by r
), whole as (select count(*) as docs, cast(sum(n) as bigint) as total from lengths
), held as (select term, count(*) as df from counted where side = 'd' group by term
), weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from held, whole
), damped as (select r, 10 + cast(90 * n * docs as bigint) // total as m from lengths, whole
), scored as (
  select b.r as item, any_value(b.id) as item_id, d.r, any_value(d.id) as doc_id,
         cast(sum(w.w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * p.m))) as bigint) as score
  from counted b join counted d on b.term = d.term and d.side = 'd' join weights w on w.term = b.term join damped p on p.r = d.r
  where b.side = 'b' group by b.r, d.r
), ranked as (select *, row_number() over (partition by item order by score desc, doc_id nulls first) as rank from scored where score > 0
)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10
"""
