"""Sharding by balanced label propagation.

Documents are linked by keys they share (here: equal texts). Every document begins in a shard by hash. In each round the
documents of a key vote, counted by (key, shard) before anything meets; members move to the shard that holds most of
their key and still has room, by quota, largest gains first; rounds end when nothing moves, which comes for certain: k
members that leave n for a shard with m >= n of their key raise the sum of squared counts by 2k(m - n) + 2k^2, which no
assignment can raise for ever. A last step deals the
surplus of overfull shards, unlinked documents first, into shards that lack rows, so that counts differ by one at most.
Only (identity, key, shard) rows take part, never texts.

Defined cases: null text is empty (size 1, crc 0) and equals an empty text; a null doc_id is a document like others;
rows that repeat a doc_id are sharded one by one; a key that holds more than a shard's quota fills shards one after the
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, positions, text_or_empty, written

SHARDS = 16


def _loads(state: DataFrame, shards: int) -> list[int]:
    n = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
    return [n.get(s, 0) for s in range(shards)]


def _of(values: list[int], shard) -> object:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (shard + 1).cast("int"))


def propagate(nodes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(id, key, linked, shard) from nodes (id, key): shards after label propagation, no shard over its quota because of a move."""
    # A table of its own leaves Spark free to split a hot key in the join, which it can't beside an aggregate of the same shuffle.
    counts = written(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("linked")))
    state = nodes.join(counts, "key", "left").select("id", "key", F.coalesce("linked", F.lit(False)).alias("linked"), F.pmod(F.xxhash64("id", F.lit(17)), F.lit(shards)).cast("int").alias("shard"))
    state = checkpoint(state)
    single, linked = state.where("not linked"), state.where("linked")
    n = state.count()
    quota = -(-n // shards)
    while True:
        # Unlinked documents give way, so only linked ones count against the quota here.
        load = _loads(linked, shards)
        room = [max(0, quota - x) for x in load]
        votes = linked.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"))
        open_votes = votes.where(_of(room, F.col("shard")) > 0)
        best = open_votes.groupBy("key").agg(F.max(F.struct("n", (-F.col("shard")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("to"), F.col("best.n").alias("most"))
        # Members of other shards with fewer votes want to move; so do equal votes to the lower number.
        wish = votes.join(best, "key").where("shard <> to and (n < most or (n = most and shard > to))").select("key", "shard", "to", (F.col("most") - F.col("n")).alias("gain"), "n")
        # Whole (key, shard) groups are admitted, largest gain first, while the room lasts; the group at the edge in part.
        order = [F.col("gain").desc(), F.col("key"), F.col("shard")]
        moving = positions_by_sum(wish, order, room)
        moving = checkpoint(moving.where("admitted > 0").select("key", "shard", "to", "admitted"))
        if moving.isEmpty():
            break
        leaving = linked.join(moving.select("key", "shard"), ["key", "shard"], "left_semi").repartition("id")  # else the numbering keeps a hot key in one task
        ranked = positions(leaving, ["key", "shard"], [F.col("id")], F.pmod(F.xxhash64("id", F.lit(3)), F.lit(256)), "rank")
        moved = ranked.join(moving, ["key", "shard"]).select("id", "key", "linked", F.when(F.col("rank") < F.col("admitted"), F.col("to")).otherwise(F.col("shard")).cast("int").alias("shard"))
        still = linked.join(moving.select("key", "shard"), ["key", "shard"], "left_anti").select("id", "key", "linked", "shard")
        linked = checkpoint(moved.unionByName(still))
    return single.unionByName(linked)


def positions_by_sum(wish: DataFrame, order: list, room: list[int]) -> DataFrame:
    """wish with `admitted`: how many of the n members of each row fit into the room of `to`, in the given order.

    The order is cut into bands of gain, so that no task sorts all wishes for a shard.
    """
    banded = wish.withColumn("band", (-F.floor(F.log2(F.col("gain") + 1) * 8)).cast("int") * 64 + F.pmod(F.xxhash64("key"), F.lit(64)).cast("int"))
    sums = banded.groupBy("to", "band").agg(F.sum("n").alias("words"))
    before = Window.partitionBy("to").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("to", "band", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("to", "band").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = banded.withColumn("upto", F.sum("n").over(inside)).join(sums, ["to", "band"])
    taken_before = F.col("start") + F.col("upto") - F.col("n")
    return rows.withColumn("admitted", F.greatest(F.lit(0), F.least(F.col("n"), _of(room, F.col("to")) - taken_before)))


def levelled(state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """state with shards whose counts differ by one at most: linked documents stay first, the surplus fills the gaps in order."""
    load = _loads(state, shards)
    n = sum(load)
    by_load = sorted(range(shards), key=lambda s: (-load[s], s))
    goal = [n // shards] * shards
    for s in by_load[: n % shards]:
        goal[s] += 1
    # Linked documents by key first and unlinked ones last; the members of a hot key are numbered in 64 parts.
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    chunk = F.when(F.col("linked"), 64 * F.pmod(F.xxhash64("key"), F.lit(256)) + part).otherwise(64 * 256 + F.pmod(F.xxhash64("id"), F.lit(256)))
    ranked = positions(state, ["shard"], [F.col("key"), F.col("id")], chunk, "rank")
    ranked = checkpoint(ranked.withColumn("over", F.col("rank") - _of(goal, F.col("shard"))))
    surplus = [max(0, a - b) for a, b in zip(load, goal, strict=True)]
    first = [sum(surplus[:s]) for s in range(shards)]
    gaps = [(s, goal[s] - load[s]) for s in range(shards) if goal[s] > load[s]]
    if not gaps:
        return ranked.drop("rank", "over")
    number = _of(first, F.col("shard")) + F.col("over")
    to, upto = F.lit(gaps[-1][0]), sum(g for _, g in gaps)
    for s, g in reversed(gaps):
        upto -= g
        to = F.when(number >= upto + g, to).otherwise(F.lit(s))
    return ranked.withColumn("shard", F.when(F.col("over") >= 0, to).otherwise(F.col("shard")).cast("int")).drop("rank", "over")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs, under the law `rows`."""
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = checkpoint(rows.withColumn("id", F.struct(F.col("doc_id"), F.monotonically_increasing_id().alias("row"))))
    state = levelled(propagate(rows.select("id", "key"), shards), shards)
    placed = rows.select("id", "size", "text_crc32").join(state.select("id", "shard"), "id")
    out = positions(placed, ["shard"], [F.col("id")], F.pmod(F.xxhash64("id"), F.lit(256)), "slot")
    return out.select(F.col("id.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
