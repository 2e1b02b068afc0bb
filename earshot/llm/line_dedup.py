"""Line dedup: lines exploded and hashed, documents counted per hash, frequent lines dropped, texts reassembled by position.

A text is split at newlines; a null or empty text is one empty line. A line's key is the line without blanks
(``\\x20\\x09-\\x0D``) at both ends and with A-Z lower-cased. Keys of at least ``min_chars`` code points found in at
least ``min_docs`` documents lose all their lines except in the largest id holding them.

Edge cases: a null id counts as the smallest id; rows of one id are one document when documents are counted, and all
their lines of a key stay or go together; a document that loses every line keeps an empty text; bytes that are no UTF-8 stay as they are; an empty table gives an
empty result; further columns stay where ``dedup_lines`` is asked for them.

Hot lines: only 128-bit hashes and ids are shuffled, a hash's rows are counted map-side before the shuffle, and the few
hashes that hold more than a thousandth of all rows each are broadcast to their rows instead of gathering them.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.base import NULL_ID, carried, keyed_texts, materialize, record, string_array, text_bytes

#: The blanks stripped from a line.
BLANKS = b" \t\n\v\f\r"

#: A key with more than this part of all rows is hot.
HOT = 1000

_LINES = pa.schema([("id", pa.int64()), ("key", pa.binary())])


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # of bytes, lower() changes A-Z only


def _chars(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def _hashed(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key; None if the key is too short to be counted."""
    if len(line) < min_chars:
        return None
    key = line_key(line)
    return xxhash.xxh3_128_digest(key) if len(key) >= min_chars and _chars(key) >= min_chars else None


def _exploder(min_chars: int):
    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text"))):
                own = {h for line in text.split(b"\n") if (h := _hashed(line, min_chars)) is not None}
                ids.extend([doc] * len(own))
                keys.extend(own)
            yield record(_LINES, id=ids, key=keys)
    return run


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(id, key): each row's distinct line hashes."""
    return keyed_texts(docs).mapInArrow(_exploder(min_chars), "id long, key binary")


def dropped_keys(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, keys): for each document that loses lines, the hashes it loses.

    Keys with enough rows are found first; only for those, which are few, are distinct documents counted. Hashes and ids
    are written once and read by each step.
    """
    lines = materialize(line_keys(docs, min_chars), "line-keys")
    hot = F.col("n") * HOT > lines.count()
    often = materialize(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs), "line-often")
    held = with_keys(lines, often, hot)
    spread = (held.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
              .agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.max("id").alias("keeper")).filter(F.col("docs") >= min_docs))
    spread = materialize(spread.select("key", "n", "keeper"), "line-keepers")
    return (with_keys(lines, spread, hot).filter(F.col("id") < F.col("keeper"))
            .groupBy("id").agg(F.collect_set("key").alias("keys")))


def with_keys(lines: DataFrame, keys: DataFrame, hot) -> DataFrame:
    """``lines`` with the columns of their key, where ``keys`` has it.

    Keys with more than a :data:`HOT`-th of all rows, fewer than so many, are broadcast, so their rows stay where they are; the
    others meet their rows by shuffle.
    """
    few = F.broadcast(keys.filter(hot))
    rest = lines.join(few.select("key"), "key", "left_anti").join(keys.filter(~hot).hint("shuffle_hash"), "key")
    return lines.join(few, "key").unionByName(rest)


def _rebuilder(min_chars: int):
    def run(batches):
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc"), ("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
            texts, counts, dropped = [], [], []
            for text, keys in zip(text_bytes(batch.column("text")), batch.column("keys").to_pylist()):
                lines = text.split(b"\n")
                lose = set(keys or ())
                kept = [line for line in lines if _hashed(line, min_chars) not in lose] if lose else lines
                texts.append(b"\n".join(kept) if lose else text)
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield record(schema, doc=batch.column("doc"), kept=string_array(texts), n_lines=counts, n_dropped=dropped)
    return run


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, kept, n_lines, n_dropped) per row of ``docs``: the row as a struct, its text without frequent lines, line counts."""
    rows = carried(docs).withColumn("id", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(NULL_ID)))
    joined = rows.join(dropped_keys(docs, min_chars, min_docs).hint("shuffle_hash"), "id", "left").select("doc", "text", "keys")
    schema = T.StructType([T.StructField("doc", joined.schema["doc"].dataType), T.StructField("kept", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_rebuilder(min_chars), schema)


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """The digest columns of query op9."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with lines as (
  select rowid as r, coalesce(doc_id, -9223372036854775808) as id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from (select row_number() over () as rowid, doc_id, text from documents)
), keyed as (
  select r, id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), often as (
  select key, max(id) as keeper from keyed where length(key) >= 20 group by key having count(distinct id) >= 3
), marked as (
  select k.*, o.key is not null and k.id < o.keeper as gone from keyed k left join often o on k.key = o.key
)
select case when any_value(id) <> -9223372036854775808 then any_value(id) end as doc_id, count(*) as n_lines,
       count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by r
"""
