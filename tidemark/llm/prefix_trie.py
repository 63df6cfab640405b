"""The prefix trie of conversations, from vertical bitmaps.

Turns are digested where they are read (two 64-bit hashes of role and text, and the text's length); from then on no text moves. They
are numbered within conversations from counts by chunks of turn numbers, and rebuilt (`rebuilt`) into the sequences of the trie.
An item is (position, turn); a node is the set of items on its way from the root, named by the exclusive or of their hashes, so
that a long conversation is cut into blocks of BLOCK positions whose beginnings are known from one row a block.

A shard is a block of at most SHARD conversations that stand next to one another by conv_id. It indexes each item to the bitset of
the shard's conversations that hold it and goes down depth first: the intersection of a node's bitset with the postings of the
next position gives its children, the popcount its members, and what no posting takes ends there. Shards hand out partial nodes,
which are added up by name, so a node that a third of all conversations share meets as one row a shard.

The sums over subtrees need no recursion. The nodes whose smallest member is c are the last ones on c's way. So what lies below a node
v and has its smallest member c lies on the way of a member c of v: all of it for c other than v's own smallest member, and for that
one what stands from v on. Leaves and saved tokens are therefore sums over v's members of one number a conversation, by a second
descent through the same shards, plus a sum from v on along one conversation.

Defined cases: rows without a conv_id belong to no conversation; null turns come first, and turns of the same number in the order of
their hashes; null roles and texts are empty; rows that repeat are turns of their own; no conversations give an empty result; other
columns are ignored. A node's list of ends is hashed in the order of conv_id by one task that holds one shard's list at a time.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, text_or_empty, written

#: Conversations c take over up to crc32(c) % TAKEN turns from the conversation c - c % GROUP.
GROUP, TAKEN = 100, 6
#: Positions of a block and conversations of a shard: a shard holds at most BLOCK * SHARD items.
BLOCK, SHARD = 128, 512
#: Turn numbers of a chunk in which turns are numbered.
CHUNK = 1024
NONE = hashlib.sha256(b"").hexdigest()

c = F.col


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, chunk, turn, t1, t2, chars: no texts from here on."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = conversations.where("conv_id IS NOT NULL").select(c("conv_id").cast("long").alias("conv"), c("turn").cast("long").alias("turn"), *[F.xxhash64(F.lit(k), role, text).alias(f"t{k}") for k in (1, 2)], F.length(text).alias("chars"))
    return rows.withColumn("chunk", F.floor(c("turn") / CHUNK))


def rebuilt(conversations: DataFrame, group: int = GROUP, taken: int = TAKEN) -> tuple[DataFrame, DataFrame]:
    """Items (conv, pos, total, t1, t2, chars), pos from 1, and conversations (conv, total), of the rebuilt sequences.

    A conversation is the first h turns of conversation c - c % group (all if it has fewer), h = crc32(c) % taken, then its own turns after its first h.
    """
    turns = written(_turns(conversations))
    counts = turns.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))))
    own = counts.groupBy("conv").agg(F.sum("rows").alias("own"))
    own = written(own.withColumns({"h": F.crc32(c("conv").cast("string").cast("binary")) % taken, "base": c("conv") - c("conv") % group}))
    there = own.where(c("conv") == c("base")).select("base", c("own").alias("n_base"))
    convs = own.join(there, "base", "left").withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.select("conv", "base", "h", "lent", (c("lent") + F.greatest(c("own") - c("h"), F.lit(0))).alias("total")))

    starts = counts.join(convs, "conv").select("conv", F.coalesce("chunk", F.lit(-(1 << 62))).alias("chunk"), "start", "h", "lent", "total")
    inside = Window.partitionBy("conv", "chunk").orderBy("turn", "t1", "t2")
    numbered = turns.withColumns({"chunk": F.coalesce("chunk", F.lit(-(1 << 62)))}).withColumn("row", F.row_number().over(inside)).join(starts, ["conv", "chunk"])
    numbered = written(numbered.select("conv", "h", "lent", "total", (c("start") + c("row")).alias("at"), "t1", "t2", "chars"))
    turn = ["t1", "t2", "chars"]
    items = numbered.where("at > h").select("conv", (c("at") - c("h") + c("lent")).alias("pos"), "total", *turn)
    heads = numbered.where((c("conv") % group == 0) & (c("at") < taken)).groupBy(c("conv").alias("base")).agg(F.collect_list(F.struct("at", *turn)).alias("head"))
    lent = convs.where("lent > 0").join(heads, "base").select("conv", "lent", "total", F.explode("head").alias("head")).where("head.at <= lent")
    return items.unionByName(lent.select("conv", c("head.at").alias("pos"), "total", *[f"head.{x}" for x in turn])), convs.select("conv", "total")


def sharded(items: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, block, pos, a, b, chars, more: items with the two halves of their names, and for each conversation and block a row of length null
    with the name of the node at which the block begins; `more` says whether the conversation goes on after the block."""
    rows = items.select("conv", F.floor((c("pos") - 1) / BLOCK).alias("block"), "pos", *[F.xxhash64(F.lit(k), "pos", "t1", "t2").alias(x) for k, x in ((1, "a"), (2, "b"))], "chars", "total")
    blocks = rows.where(c("total") > BLOCK).groupBy("conv", "block", "total").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select("conv", "block", "total", *[F.bit_xor(x).over(before).alias(x) for x in "ab"]).where("block > 0")
    first = convs.select("conv", F.lit(0).cast("long").alias("block"), "total", *[F.lit(0).cast("long").alias(x) for x in "ab"])
    heads = first.unionByName(later).withColumns({"pos": c("block") * BLOCK, "chars": F.lit(None).cast("int")})
    return rows.unionByName(heads).withColumn("more", c("total") > (c("block") + 1) * BLOCK).drop("total")


def _descend(rows: list[dict], emit) -> None:
    """Depth-first through one shard: rows of one block, by conversation and position."""
    convs = list(dict.fromkeys(r["conv"] for r in rows))
    number = {v: k for k, v in enumerate(convs)}
    postings: dict[tuple[int, int, int], int] = {}
    at: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in convs]
    top: dict[tuple[int, int, int], int] = {}
    more, weights = 0, [(0, 0)] * len(convs)
    for r in rows:
        k = number[r["conv"]]
        if r["chars"] is None:
            name = (r["pos"], r["a"], r["b"])
            top[name] = top.get(name, 0) | 1 << k
            more |= r["more"] << k
            weights[k] = (r["saved"], r["leaf"])
        else:
            item = (r["pos"], r["a"], r["b"])
            postings[item] = postings.get(item, 0) | 1 << k
            at[k][r["pos"]] = (*item, r["chars"])
    stack = [(depth, a, b, None, 0, bits) for (depth, a, b), bits in top.items()]
    while stack:
        depth, a, b, parent, chars, bits = stack.pop()
        rest, ended = bits, []
        while rest:
            k = (rest & -rest).bit_length() - 1
            if item := at[k].get(depth + 1):
                child = bits & postings[item[:3]]
                stack.append((depth + 1, a ^ item[1], b ^ item[2], (a, b), item[3], child))
                rest &= ~child
            else:
                if not more >> k & 1:
                    ended.append(convs[k])
                rest &= rest - 1
        if parent or depth == 0:
            rest, saved, leaves = bits, 0, 0
            while rest:
                own = weights[(rest & -rest).bit_length() - 1]
                saved, leaves, rest = saved + own[0], leaves + own[1], rest & rest - 1
            low = convs[(bits & -bits).bit_length() - 1]
            emit(depth, a, b, *(parent or (None, None)), low, bits.bit_count(), chars, ",".join(map(str, ended)) or None, saved, leaves)


_PARTIAL = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("pa", pa.int64()), ("pb", pa.int64()), ("low", pa.int64()), ("members", pa.int64()), ("chars", pa.int64()), ("ends", pa.string()), ("saved", pa.int64()), ("leaves", pa.int64())])
PARTIAL = "depth long, a long, b long, pa long, pb long, low long, members long, chars long, ends string, saved long, leaves long"


def partials(shards: DataFrame, size: int = SHARD) -> DataFrame:
    """The nodes of each shard, with their members there and the sums of the members' `saved` and `leaf`."""

    def units(batches):
        """The rows of one conversation and block after another, in order, whatever batch they came in."""
        rows = (r for batch in batches for r in batch.to_pylist())
        for key, unit in groupby(rows, lambda r: (r["block"], r["conv"])):
            yield key[0], list(unit)

    def run(batches):
        held: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), _PARTIAL.types, strict=True)], schema=_PARTIAL)

        for _, block in groupby(units(batches), lambda x: x[0]):
            shard: list[dict] = []
            for k, (_, unit) in enumerate(block):
                if k % size == 0 and shard:
                    _descend(shard, lambda *row: held.append(row))
                    shard = []
                    if len(held) > 10_000:
                        yield out()
                        held = []
                shard += unit
            _descend(shard, lambda *row: held.append(row))
        if held:
            yield out()

    rows = shards.repartitionByRange("block", "conv").sortWithinPartitions("block", "conv", "pos")
    return in_batches(rows, run, PARTIAL)


def _ends(nodes: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: the lists of a node's shards, smallest first, through one hash."""
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        rows = (r for batch in batches for r in zip(*(batch[x].to_pylist() for x in ("depth", "a", "b", "ends")), strict=True))
        done: list[tuple] = []
        for name, lists in groupby(rows, lambda r: r[:3]):
            digest, lead = hashlib.sha256(), b""
            for r in lists:
                digest.update(lead + r[3].encode())
                lead = b","
            done.append((*name, digest.hexdigest()))
            if len(done) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

    lists = nodes.where("ends IS NOT NULL").select("depth", "a", "b", "first", "ends")
    return in_batches(lists.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "first"), run, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, group: int = GROUP, taken: int = TAKEN, size: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    name = ["depth", "a", "b"]
    items, convs = rebuilt(conversations, group, taken)
    shards = written(sharded(items, convs))
    zero = {"saved": F.lit(0).cast("long"), "leaf": F.lit(0)}
    first = c("ends").substr(F.lit(1), F.coalesce(F.nullif(F.instr("ends", ","), F.lit(0)) - 1, F.length("ends"))).cast("long")
    found = written(partials(shards.withColumns(zero), size).withColumn("first", first))
    nodes = found.groupBy(*name).agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("low").alias("conv_id"), F.sum("members").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = written(nodes)
    children = nodes.where("depth > 0").groupBy((c("depth") - 1).alias("depth"), c("pa").alias("a"), c("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, name, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "own": (c("n_convs") - 1) * c("chars")})
    nodes = written(nodes)

    weights = nodes.groupBy(c("conv_id").alias("conv")).agg(F.sum("own").alias("saved"), F.max((c("n_children") == 0).cast("int")).alias("leaf"))
    heads = shards.where("chars IS NULL").join(weights, "conv", "left").fillna(0, ["saved", "leaf"])
    sums = partials(shards.where("chars IS NOT NULL").withColumns(zero).unionByName(heads), size).groupBy(*name).agg(F.sum("saved").alias("below"), F.sum("leaves").alias("n_leaves"))

    # Of the smallest member's own nodes only those from here on count: what stands above goes off. Nodes of one member save nothing.
    shared = nodes.where("n_convs > 1").select(*name, "conv_id", "own", F.floor(c("depth") / BLOCK).alias("block"))
    totals = shared.groupBy("conv_id", "block").agg(F.sum("own").alias("total"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = shared.withColumn("here", F.coalesce(F.sum("own").over(inside), F.lit(0))).join(totals.withColumn("prior", F.coalesce(F.sum("total").over(before), F.lit(0))), ["conv_id", "block"])
    above = above.select(*name, (c("here") + c("prior")).alias("above"))

    parents = nodes.select((c("depth") + 1).alias("depth"), c("a").alias("pa"), c("b").alias("pb"), c("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, name).join(above, name, "left").join(_ends(found), name, "left")
    root = parents.where("depth = 1").select("parent_conv_id")
    low = out.where("depth = 1").crossJoin(F.broadcast(root))  # one row: there is one root
    rest = out.where("depth <> 1").join(parents.where("depth > 1"), ["depth", "pa", "pb"], "left")
    out = low.unionByName(rest)
    saved = F.when(c("n_convs") > 1, c("below") - c("above")).otherwise(F.lit(0))
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv::varchar) + 1), lambda i: ascii(substr(conv::varchar, i::int, 1))::bigint)),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"""
SQL = f"""
WITH t AS (SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv, conv - conv % {GROUP} AS base, {_CRC} % {TAKEN} AS h FROM (SELECT DISTINCT conv FROM t)),
r AS (SELECT k.conv, t.place, role, text FROM k JOIN t ON t.conv = k.base AND t.place <= h
      UNION ALL SELECT k.conv, t.place, role, text FROM k JOIN t ON t.conv = k.conv AND t.place > h),
p AS (SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY place) AS depth, text, md5(role || chr(1) || text) AS item FROM r),
s AS (SELECT conv, depth, length(text) AS chars, md5(string_agg(item, '') OVER (PARTITION BY conv ORDER BY depth)) AS node, depth = count(*) OVER (PARTITION BY conv) AS ended FROM p
      UNION ALL SELECT conv, 0, 0, '', conv NOT IN (SELECT conv FROM p) FROM k),
w AS (SELECT *, lag(node) OVER (PARTITION BY conv ORDER BY depth) AS parent FROM s),
n AS (SELECT node, depth, any_value(parent) AS parent, min(conv) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv::varchar, ',' ORDER BY conv) FILTER (ended), '')) AS ends_sha256 FROM w GROUP BY node, depth),
q AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN q ON q.parent = n.node),
b AS (SELECT s.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens FROM f JOIN s ON s.conv = f.conv_id AND s.depth <= f.depth GROUP BY s.node)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens::bigint AS saved_tokens, f.ends_sha256
FROM f JOIN b USING (node) LEFT JOIN n u ON u.node = f.parent AND f.depth > 0"""
