"""Merkle manifest of a table: nested-interval labels, containment joins for ancestors, interval differences for siblings.

A leaf is the sha256 of a row's fields. The leaves of a source stand in order of their ids, and while a source has several
nodes, every ``FANOUT`` consecutive ones become the sha256 of their digests. The subroots of the sources, in order of the
sources, become one root in the same way.

A node carries the interval [lo, hi) of the leaf ranks that it covers. A level's intervals start at multiples of the
level's width, so a node finds its parent by the bucket of its ``lo`` at the next width, and the join then asks for
containment. What the parent's interval holds beside the node's own are the siblings: the children that end where the node
starts or before, and those that start where it ends or after. A node's ``path`` is this pair of sibling runs for it and for
each ancestor. Paths are attached from the root down, so a level takes over what its parents know, and only the last join
meets the leaves; there one join by (source, bucket) gives each leaf all siblings up to the root.

Hot sources: leaves are numbered by ranges of (source, id), and every later key holds at most ``FANOUT`` rows.

Edge cases: a null field is ``-``; null and empty texts differ; a null source is a source of its own and comes first; rows
of a null id come first in their source and are never tampered with; rows that repeat an id are ordered by their leaves,
equal rows follow each other; a table of one row has the leaf as its root and no siblings; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.base import NULL_ID, given_id, materialize
from earshot.llm.places import numbered

FANOUT = 16
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A field as hashed: ``-`` if null, else its number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, some of them changed."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def lower_cased(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def is_tampered(id_column: Column) -> Column:
    """Rows whose texts the check of the manifest changes: every fifth by the CRC-32 of the id in decimal."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _joined(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["digest"]), "")


def tree_levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Nodes by level, the leaves first: tree, n (leaves of the tree), lo, hi, digest and, above the leaves, children.

    ``leaves``: tree, n, lo, digest, where lo is the rank in the tree. Several trees are built at once; the nodes of a tree
    end with the level on which it has one node.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves.withColumn("hi", F.col("lo") + 1)]
    width = 1
    while width < most:
        below = levels[-1].filter(F.col("n") > width)  # trees that have several nodes there
        width *= FANOUT
        run = below.groupBy("tree", F.floor(F.col("lo") / width).alias("_run")).agg(
            F.first("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        levels.append(materialize(run.select("tree", "n", "lo", "hi", F.sha2(_joined(F.col("children")), 256).alias("digest"), "children"),
                                  f"{name}-{len(levels)}"))
    return levels


def tree_roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the one node of each tree that covers all of its leaves, on the lowest such level."""
    found = None
    for k, nodes in enumerate(levels):
        own = nodes.filter((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select("tree", F.col("digest").alias("top"))
        found = own if found is None else found.unionByName(own)
    return found


def with_paths(levels: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """The leaves with ``top`` (their tree's root) and ``path`` (siblings from the leaf's level up).

    ``tops``: tree, top, path of each tree's root, with the siblings that lie above this tree.
    """
    above = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        whole = nodes.filter((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).join(tops, "tree")
        if above is not None:
            parents = above.select("tree", F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "children", "top", "path")
            parents = parents.withColumnRenamed("children", "family")
            width = FANOUT ** (k + 1)
            held = nodes.withColumn("_run", F.floor(F.col("lo") / width)).join(
                parents.withColumn("_run", F.floor(F.col("p_lo") / width)), ["tree", "_run"])
            held = held.filter((F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
            left = _joined(F.filter("family", lambda c: c["hi"] <= F.col("lo")))
            right = _joined(F.filter("family", lambda c: c["lo"] >= F.col("hi")))
            path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
            held = held.withColumn("path", path).select(*whole.columns)
            whole = whole.unionByName(held)
        above = whole if k == 0 else materialize(whole, f"{name}-paths-{k}")
    return above


def siblings(path: Column) -> Column:
    """All sibling digests of a path, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, digest, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: id, digest (leaf), changed (leaf after tampering, else null), subroot, root, path."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("source").cast("string").alias("source"),
        leaf().alias("digest"), F.when(is_tampered(F.col("doc_id")), leaf(text=lower_cased(F.col("text").cast("string")))).alias("changed"))
    rows = numbered(materialize(rows, "merkle-leaves"), ["source"], ["id", "digest"], "merkle-order")
    # A source is the interval of places that its rows hold, so its first place names it and orders it.
    rows = materialize(rows.select("id", "digest", "changed", F.col("start").alias("tree"), (F.col("place") - F.col("start")).alias("lo"), "n"),
                       "merkle-ranks")
    levels = tree_levels(rows, "merkle")
    subroots = numbered(tree_roots(levels), [], ["tree"], "merkle-sources")
    uppers = tree_levels(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("own"), F.col("place").alias("lo"), "n",
                                         F.col("top").alias("digest")), "merkle-upper")
    root = tree_roots(uppers).withColumn("path", F.array().cast(_PATH))
    tops = with_paths(uppers, root, "merkle-upper").select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "path",
                                                            F.col("top").alias("root"))
    tops = materialize(tops.select("tree", F.struct("subroot", "root").alias("top"), "path"), "merkle-tops")
    return with_paths(levels, tops, "merkle").select("id", "digest", "changed", "top.subroot", "top.root", "path")


def manifest_report(docs: DataFrame) -> DataFrame:
    """The digest columns of query op12."""
    told = manifest(docs).withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("path")))
    return told.select(given_id(), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(levels: int = 8) -> str:
    """SQL for at most FANOUT^levels rows of a source, and as many sources: a tree that has one node passes further levels as it is."""
    fields = {"doc_id": "cast(doc_id as varchar)", "source": "source", "lang": "lang", "n_chars": "cast(n_chars as varchar)", "text": "text"}

    def leaf_of(text: str) -> str:
        said = " || ".join(f"coalesce(cast(strlen({v}) as varchar) || ':' || {v}, '-')" for v in {**fields, "text": text}.values())
        return f"sha256({said})"
    parts = [f"""crc_bits as (
  select i, i as c, 0 as k from (select unnest(range(256)) as i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_bits where k < 8
), crc_table as (select list(c order by i) as entries from crc_bits where k = 8
), crcs as (
  select d.*, xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda s: cast(ascii(s) as bigint)),
                              lambda c, b: xor(c >> 8, entries[xor(c, b) % 256 + 1]), 4294967295), 4294967295) as crc
  from (select row_number() over () as rid, doc_id, source, lang, n_chars, text from documents) d, crc_table
), hashed as (
  select rid, doc_id, source, {leaf_of('text')} as leaf, case when crc % 5 = 0 then {leaf_of(f"translate(text, '{_UPPER}', '{_LOWER}')")} end as changed
  from crcs
), t0 as (
  select rid, source, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, leaf as digest,
         count(*) over (partition by source) as n
  from hashed
)"""]

    def climb(prefix: str, group: str) -> None:
        """Nodes by level and each node's siblings left (a) and right (z); ``n`` counts the tree's nodes on the level."""
        for k in range(levels):
            parts.append(f"""{prefix}f{k} as (
  select {group}, pos // {FANOUT} as run, list(struct_pack(pos := pos, digest := digest) order by pos) as family, any_value(n) as n
  from {prefix}{k} group by {group}, pos // {FANOUT}
), {prefix}s{k} as (
  select c.*, array_to_string(list_transform(list_filter(f.family, lambda x: x.pos < c.pos), lambda x: x.digest), '') as a,
         array_to_string(list_transform(list_filter(f.family, lambda x: x.pos > c.pos), lambda x: x.digest), '') as z, c.n > 1 as up
  from {prefix}{k} c join {prefix}f{k} f on c.{group} is not distinct from f.{group} and c.pos // {FANOUT} = f.run
), {prefix}{k + 1} as (
  select {group}, run as pos, case when n = 1 then family[1].digest else sha256(array_to_string(list_transform(family, lambda x: x.digest), '')) end as digest,
         (n + {FANOUT - 1}) // {FANOUT} as n
  from {prefix}f{k}
)""")
    climb("t", "source")
    parts.append(f"u0 as (select 0 as one, source, row_number() over (order by source nulls first) - 1 as pos, digest, count(*) over () as n from t{levels})")
    climb("u", "one")
    steps = [f"ts{k}" for k in range(levels)] + [f"us{k}" for k in range(levels)]
    joins = [f"join ts{k} on ts{k}.source is not distinct from t0.source and ts{k}.pos = t0.pos // {FANOUT ** k}" for k in range(levels)]
    joins.append("join us0 on us0.source is not distinct from t0.source")
    joins += [f"join us{k} on us{k}.pos = us0.pos // {FANOUT ** k}" for k in range(1, levels)]
    kept = ", ".join(f"{s}.a as {s}_a, {s}.z as {s}_z, {s}.up as {s}_up" for s in steps)
    parts.append(f"""fold0 as (
  select h.doc_id, h.leaf, us0.digest as subroot, u{levels}.digest as root, coalesce(h.changed, h.leaf) as f, {kept}
  from t0 join hashed h on h.rid = t0.rid {' '.join(joins)} join u{levels} on u{levels}.pos = 0
)""")
    for i, s in enumerate(steps):
        parts.append(f"fold{i + 1} as (select * replace (case when {s}_up then sha256({s}_a || f || {s}_z) else f end as f) from fold{i})")
    proof = " || ".join(f"{s}_a || {s}_z" for s in steps)
    return (f"with recursive {', '.join(parts)} select doc_id, leaf, subroot, root, sha256({proof}) as proof_sha256, f as folded_root, "
            f"f = root as verified from fold{len(steps)}")


ORACLE_SQL = _oracle()
