"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The 64-bit hashes of a text's five-word shingles are computed once. The top bits of a hash are its bin, and the least
hash of each bin stays. An empty bin copies a bin that its own random probe order reaches first (optimal densification:
the choice depends on the empty bin and the attempt only, so two texts with equal bins fill them equally). Of each bin
the low bits are stored, packed as hex. Two fingerprints' share of equal bins, corrected for bins that agree by chance
(one in 2^bits), estimates the Jaccard similarity of the shingle sets.

Words are runs of characters other than ``\\x20\\x09-\\x0D`` of the lower-cased text. A text of fewer words than a shingle is
one shingle; a text without words has the hash of no word as its only one.

Edge cases: a null text is empty; ids order the documents, a null id is the smallest, and rows of one id are ordered by
text; equal rows follow each other in either order, which gives the same rows; in a table of one row it is its own
successor; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.base import NULL_ID, given_id

#: Words of a shingle, bins (2^BIN_BITS), low bits kept of each, documents that meet in one window.
SHINGLE, BIN_BITS, LOW_BITS, GROUP = 5, 8, 8, 1024
BINS = 1 << BIN_BITS

#: Probes that are tried one by one.
_TRIES = 16


def _bin(h: Column) -> Column:
    """Top bits of a hash, in the order of signed numbers."""
    return F.shiftright(h, 64 - BIN_BITS)


def _last(b: int) -> int:
    """The largest hash of bin ``b``."""
    return (b + 1 << 64 - BIN_BITS) - 1 - (1 << 63)


def _stride(b: int) -> int:
    """Odd, so that a bin's probes b*step + offset visit every bin once."""
    return (b * 0x9E3779B1 >> 7 ^ b * 0x85EBCA6B >> 11) * 2 + 1 & BINS - 1


def _offset(b: int) -> int:
    return b * 157 + 53  # another bin for each, modulo BINS


def probes(b: int) -> list[int]:
    """The order in which empty bin ``b`` looks at the bins."""
    return [(j * _stride(b) + _offset(b)) % BINS for j in range(BINS)]


def with_low_bits(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the low bits of each bin of a text column, as an array of :data:`BINS` bytes.

    The sort stands by itself, outside of lambdas, where it runs on plain longs.
    """
    blank = F.lower(F.coalesce(F.col(text), F.lit("")))
    for sign in "\t\n\v\f\r":
        blank = F.replace(blank, F.lit(sign), F.lit(" "))
    words = F.transform(F.filter(F.split(blank, " "), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(own: Column) -> Column:
        short = F.xxhash64(*(F.get(own, F.lit(k)) for k in range(SHINGLE - 1)), F.size(own))
        return F.when(F.size(own) < SHINGLE, F.array(short)).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(own) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(own, i + k) for k in range(SHINGLE)))))
    # The largest possible hash of each bin is added, so each bin comes up, and sorted hashes come bin by bin.
    lasts = F.lit([_last(b) for b in range(BINS)])
    out = df.withColumn("_sorted", F.sort_array(F.concat(_over(words, shingles), lasts)))

    def dense(ordered: Column) -> Column:
        """The least hash of each bin, null where empty."""
        least = F.filter(ordered, lambda h, i: F.coalesce(_bin(h) != _bin(F.get(ordered, i - 1)), F.lit(True)))
        return F.transform(least, lambda h, b: F.nullif(h, F.get(lasts, b)))

    # An empty bin tries its first probes; in texts that fill few bins these mostly fail, and then it is told for each
    # filled bin when the probe order would reach it. Filled bins are packed as bin and low bits.
    first_probes = [F.lit([probes(b)[j] for b in range(BINS)]) for j in range(_TRIES)]
    offsets, inverses = F.lit([_offset(b) % BINS for b in range(BINS)]), F.lit([pow(_stride(b), -1, BINS) for b in range(BINS)])
    low = (1 << LOW_BITS) - 1

    def filled(held: Column) -> Column:
        packed_bins = F.filter(F.transform(held, lambda h, b: F.shiftleft(b.cast("long"), LOW_BITS).bitwiseOR(h.bitwiseAND(F.lit(low)))),
                               lambda x: x.isNotNull())

        def reached(full: Column) -> Column:
            def when(x: Column, b: Column) -> Column:
                attempt = ((F.shiftright(x, LOW_BITS) - F.get(offsets, b)) * F.get(inverses, b)).bitwiseAND(F.lit(BINS - 1))
                return F.shiftleft(attempt, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit(low)))
            return F.transform(held, lambda v, b: F.coalesce(
                v, *(F.get(held, F.get(at, b)) for at in first_probes), F.array_min(F.transform(full, lambda x: when(x, b)))))
        return _over(packed_bins, reached)
    # Shifted up and down again the low bits are a signed byte.
    lows = F.transform(_over(_over(F.col("_sorted"), dense), filled),
                       lambda h: F.shiftright(F.shiftleft(h, 64 - LOW_BITS), 64 - LOW_BITS).cast("byte"))
    return out.withColumn(name, lows).drop("_sorted")


def _over(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once: as the only element of an array that is transformed."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def packed(lows: Column) -> Column:
    """The low bits as a hex string."""
    return F.lower(F.array_join(F.transform(lows, lambda b: F.lpad(F.hex(b.cast("int").bitwiseAND(F.lit(255))), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity, 0 to 1: the share of equal bins without those that agree by chance."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def with_successor(rows: DataFrame, columns: list[str], derive=lambda df: df) -> DataFrame:
    """``rows`` (id, text, ...) with struct ``next``: ``columns`` of the following row by descending id, the last row's being the first.

    ``derive`` adds the columns that are costly: it is applied to the rows once, and to the first rows of ranges, which are
    picked by id and text before.

    Ids are cut into ranges of :data:`GROUP` values. A window orders each range, and each range's last row gets the first
    row of the next range that has rows. Those first rows are handled alike, with ranges of ranges, until few are left,
    so no task orders more than one range whatever the ids. The texts are shuffled by range once.
    """
    order = [F.col("id").desc(), F.col("text").desc()]
    shift = GROUP.bit_length() - 1
    ranged = rows.withColumn("range", F.shiftright("id", shift))
    inside = Window.partitionBy("range").orderBy(*order)
    told = derive(ranged).withColumn("next", F.lead(F.struct(*columns)).over(inside))
    firsts = ranged.withColumn("nth", F.row_number().over(inside)).filter("nth = 1").drop("nth")
    heads = derive(firsts).select(F.col("range").alias("own"), F.struct(*columns).alias("head"))
    following = _next_ranges(ranged.select("range").distinct(), shift)  # from the ids alone
    first = heads.join(following, F.col("own") == F.col("after")).select("before", "head")
    found = told.join(first, (F.col("range") == F.col("before")) & F.col("next").isNull(), "left")
    return found.withColumn("next", F.coalesce("next", "head")).drop("range", "before", "head")


def _next_ranges(ranges: DataFrame, shift: int) -> DataFrame:
    """(before, after): for each range the next smaller one that has rows; after the smallest comes the largest."""
    low, high = ranges.agg(F.min("range"), F.max("range")).first()
    if low is None or high - low < 4096:  # so many rows at most
        by = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc())
        return ranges.select(F.col("range").alias("before"), F.coalesce(F.lead("range").over(by), F.lit(high)).alias("after"))
    upper = ranges.withColumn("upper", F.shiftright("range", shift))
    by = Window.partitionBy("upper").orderBy(F.col("range").desc())
    told = upper.withColumns({"inside": F.lead("range").over(by), "nth": F.row_number().over(by)})
    heads = told.filter("nth = 1").select(F.col("upper").alias("own"), F.col("range").alias("head"))
    following = _next_ranges(upper.select(F.col("upper").alias("range")).distinct(), shift)
    first = heads.join(following, F.col("own") == F.col("after")).select(F.col("before").alias("from"), "head")
    return told.join(first, F.col("upper") == F.col("from")).select(
        F.col("range").alias("before"), F.coalesce("inside", "head").alias("after"))


def texts(docs: DataFrame) -> DataFrame:
    """(id, text): null ids as the smallest, null texts empty."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, text, lows): each row's low bits by bin."""
    return with_low_bits(texts(docs), "text", "lows")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """The digest columns of query op10."""
    linked = with_successor(texts(docs), ["text", "lows"], lambda df: with_low_bits(df, "text", "lows"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.col("next.text"), F.lit(1), half))
    both = linked.select("id", n.cast("long").alias("n_chars"), "lows", F.col("next.lows").alias("next_lows"), edited.alias("edited"))
    told = with_low_bits(both, "edited", "edited_lows")
    return told.select(
        given_id(), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("lows")).alias("fingerprint"),
        packed(F.col("edited_lows")).alias("edited_fingerprint"), likeness(F.col("lows"), F.col("edited_lows")).alias("near_edited"),
        likeness(F.col("lows"), F.col("next_lows")).alias("near_next"))
