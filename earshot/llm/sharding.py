"""Shards by balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

The links of documents are given as hubs: documents of one hub (here: one text) are neighbours of each other. A hub carries
no weight and is no row, so a group of any size has as many links as members and never its pairs. Shards hold equally many
rows, one more in the first ``rows mod shards``.

1. Every linked document starts in a shard by the hash of its id, which is even up to chance.
2. A round of joins: members are counted by hub and shard; a hub favours the shard that most of its members hold (several,
   if it is larger than a shard); members that are elsewhere ask to move there.
3. The requests are counted by pair of shards, and a quota is found for each pair: what may enter a shard is what leaves
   it and the room that is left for linked documents. Requests are granted hub by hub, in an order by hash, up to the quota.
4. Rounds end when nothing moves, or after ``MOST_ROUNDS``.
5. Documents are put in one global order by shard and hub. Those beyond a shard's capacity, and all that have no
   neighbours, fill the room that is left, place by place. So counts differ by at most one, whatever the rounds reached,
   and the number inside the shard comes out of the same order.

Hot groups: members are counted map-side, quotas are one number per pair of shards, and the order is dealt by ranges, so no
task holds a hub or a shard. The driver sees counts by pair of shards and bucket of hashes, of bounded number.

Edge cases: a null text is of no bytes, like an empty one, and both are equal texts; null ids count as the smallest; rows
that repeat an id are rows of their own; with fewer rows than shards the first shards hold one each; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.base import NULL_ID, Steps, given_id, materialize
from earshot.llm.places import numbered

#: Rounds of moves at most; what is then apart stays apart.
MOST_ROUNDS = 12
#: Buckets by hash in which requests are granted.
BUCKETS = 512
#: A hub of more than this part of a shard is wide: there are at most so many times the shards of them.
WIDE = 64


def _hash(modulus: int, *parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(modulus))


def flow(asked: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Moves allowed from shard to shard, at most those asked for, so that no shard takes in more than leaves it and its room.

    Requests into shards that would overflow are cut in proportion. A cut lets less leave other shards, so this repeats
    until it holds; allowed moves only fall, and none at all always hold.
    """
    allowed = asked.astype(np.float64)
    for _ in range(1000):
        into, out = allowed.sum(axis=0), allowed.sum(axis=1)
        limit = np.maximum(room, 0) + out
        over = into > limit + 1e-6
        if not over.any():
            break
        allowed[:, over] *= limit[over] / into[over]
    else:
        return np.zeros_like(asked)
    return np.floor(allowed + 1e-6).astype(np.int64)


def of_hubs(rows: DataFrame, hubs: DataFrame, wide: Column) -> DataFrame:
    """``rows`` with the columns of their hub, null where ``hubs`` lacks it.

    Hubs of condition ``wide``, of which there are few by a proven bound, are broadcast, so their many rows stay where they
    are; the other rows meet their hub by shuffle.
    """
    few = F.broadcast(hubs.filter(wide))
    near = rows.join(few, "hub")
    return near.unionByName(rows.join(few.select("hub"), "hub", "left_anti").join(hubs.filter(~wide), "hub", "left"))


def _favourites(state: DataFrame, capacity: int, turn: int) -> DataFrame:
    """(hub, wide, shards): the shards a hub favours, those with most members first, and whether it needs several.

    Among shards of equally many members the hash of hub, shard and round decides, so hubs spread over the shards.
    """
    held = state.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("members"))
    ranked = held.groupBy("hub").agg(  # a hub has as many rows here as there are shards at most
        F.sum("members").alias("size"),
        F.sort_array(F.collect_list(F.struct("members", F.xxhash64("hub", "shard", F.lit(turn)).alias("tie"), "shard")), asc=False).alias("order"))
    wanted = F.ceil(F.col("size") / max(1, capacity))
    return ranked.filter(F.size("order") > 1).select(
        "hub", (F.col("size") * WIDE > capacity).alias("wide"),
        F.transform(F.slice("order", F.lit(1), wanted.cast("int")), lambda s: s["shard"]).alias("shards"))


def propagate(linked: DataFrame, capacities: list[int], rounds: int = MOST_ROUNDS) -> DataFrame:
    """``linked`` (id, hub, ...) with ``shard``: labels after the rounds; a shard's count may still be off its capacity."""
    shards = len(capacities)
    spark = linked.sparkSession
    states, requests, favours = (Steps(spark, f"shards-{name}") for name in ("state", "asking", "likes"))
    state = states.write(linked.withColumn("shard", _hash(shards, "id", "hub").cast("int")))
    for turn in range(1, rounds + 1):
        likes = favours.write(_favourites(state, capacities[0], turn))
        # A hub that fits asks as a whole; one of several shards, or of a large part of one, asks member by member.
        asking = of_hubs(state, likes, F.col("wide"))
        pick = F.get("shards", _hash(1 << 30, "id", F.lit(turn)).cast("int") % F.greatest(F.size("shards"), F.lit(1)))
        target = F.when(F.array_contains("shards", F.col("shard")), F.col("shard")).otherwise(pick)
        order = F.when(F.col("wide"), BUCKETS + _hash(BUCKETS, "id", F.lit(-turn))).otherwise(_hash(BUCKETS, "hub", F.lit(-turn)))
        asking = requests.write(asking.select(*state.columns, F.coalesce(target, F.col("shard")).alias("to"), order.cast("int").alias("turn_order")))
        moves = _granted(asking, capacities)
        if not moves:
            break
        # One number per pair of shards: the last bucket that may move.
        edge = F.element_at(F.create_map(*(F.lit(x) for pair in moves.items() for x in pair)), F.col("shard") * shards + F.col("to"))
        state = states.write(asking.withColumn("shard", F.when(F.col("turn_order") <= edge, F.col("to")).otherwise(F.col("shard")))
                             .select(*state.columns))
    return state


def _granted(asking: DataFrame, capacities: list[int]) -> dict[int, int]:
    """For each pair of shards (from * shards + to) the last bucket of requests that is granted."""
    shards = len(capacities)
    counts = asking.groupBy("shard", "to", "turn_order").agg(F.count(F.lit(1)).alias("n")).filter("shard <> to").toPandas()
    held = np.zeros(shards, dtype=np.int64)
    for row in asking.groupBy("shard").count().collect():
        held[row["shard"]] = row["count"]
    asked = np.zeros((shards, shards), dtype=np.int64)
    np.add.at(asked, (counts["shard"], counts["to"]), counts["n"])
    allowed = flow(asked, np.array(capacities) - held)
    moves = {}
    for (a, b), rows in counts.sort_values("turn_order").groupby(["shard", "to"]):
        fits = rows["turn_order"][rows["n"].cumsum() <= allowed[a, b]]
        if len(fits):
            moves[int(a) * shards + int(b)] = int(fits.iloc[-1])
    return moves


def balanced_shards(rows: DataFrame, shards: int = 40, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``rows`` (id, hub, ...) with ``shard`` and ``slot``: counts of the shards differ by at most one, slots run from 0.

    Documents of one hub are neighbours. ``rows`` are read several times and should be a stored table.
    """
    total = rows.count()
    capacities = [total // shards + (k < total % shards) for k in range(shards)]
    several = materialize(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "shards-hubs")
    told = of_hubs(rows, several, F.col("members") * WIDE > max(capacities))
    linked = propagate(told.filter("members > 1").select(*rows.columns), capacities, rounds)
    alone = told.filter("members is null").select(*rows.columns, F.lit(shards).alias("shard"))
    placed = numbered(linked.unionByName(alone), ["shard"], ["hub", "id"], "shards-order")
    held = dict(linked.groupBy("shard").count().collect())
    kept = [min(held.get(k, 0), capacities[k]) for k in range(shards)]
    spare = [max(held.get(k, 0) - capacities[k], 0) for k in range(shards)]
    # The pool: documents beyond a shard's capacity, shard by shard, then those without neighbours.
    pool_before = np.concatenate([[0], np.cumsum(spare)]).tolist()
    room_before = np.concatenate([[0], np.cumsum(np.array(capacities) - kept)]).tolist()

    def of(values: list[int], index: Column) -> Column:
        return F.get(F.lit([int(v) for v in values]), index)
    inside = F.col("place") - F.col("start")
    stays = (F.col("shard") < shards) & (inside < of([*kept, 0], F.col("shard")))
    pool = of(pool_before, F.col("shard")) + inside - of([*kept, 0], F.col("shard"))
    filled = F.size(F.filter(F.lit([int(v) for v in room_before[1:]]), lambda end: end <= F.col("pool")))
    told = placed.withColumns({"pool": F.when(~stays, pool), "inside": inside})
    told = told.withColumn("to", F.when(F.col("pool").isNull(), F.col("shard")).otherwise(filled).cast("int"))
    slot = F.when(F.col("pool").isNull(), F.col("inside")).otherwise(
        of(kept, F.col("to")) + F.col("pool") - of(room_before, F.col("to")))
    return told.select(*rows.columns, F.col("to").alias("shard"), slot.cast("long").alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """id, size (bytes of the text and 16), text_crc32, hub (digest of the text), shard and slot of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
                       (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.unhex(F.sha2(text, 256)).alias("hub"))
    return balanced_shards(materialize(rows, "shards-rows"), shards)


def sharding_report(docs: DataFrame) -> DataFrame:
    """The digest columns of query op13."""
    return sharded_documents(docs).select(
        given_id(), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
