"""Best-fit packing by the linear grouping scheme.

Documents become token ids (and a closing id 0) in tasks, and leave them as pieces of at most CAPACITY tokens: identity,
length and checksum, not ids. From then on the driver needs only the histogram of lengths, at most CAPACITY numbers
whatever the corpus, and from it makes the plan:

1. Lengths over SMALL are cut, from the longest, into GROUPS groups of equal cardinality; each is rounded up to its
   group's longest.
2. For these few sizes the best configurations of one sequence are found by column generation: a linear programme over
   configurations, priced by a knapsack; whole numbers of each are taken and the rest is packed best-fit decreasing.
3. Actual lengths take their group's places, in order of rank, which leaves more room than planned.
4. The small lengths go best-fit decreasing into the room left, then into new sequences.

The plan is a list of runs: the pieces of a length with ranks from a to b go to consecutive sequences at one offset.
Pieces are ranked inside their length by `positions`, in Spark, and find their run by rank. The plan's size depends on
CAPACITY and GROUPS, not on the rows.

Defined cases: null or empty text is one piece of one token; a longer document's first piece is the shorter one; rows
that repeat a doc_id are packed as separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, in_batches, positions

CAPACITY, GROUPS = 2048, 32
SMALL = CAPACITY // 8
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(folder: str | None = None):
    """text -> ids of byte_bpe_50k. Texts with the special token's string go through `tokenizers`, which treats it apart; all others through the same vocabulary as ranks, whose ids are equal and which is several times faster."""
    import public_tokenizers as public
    import tiktoken

    at = (lambda name: f"{folder}/{name}") if folder else public.path
    with open(at("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> list[int]:
        if SPECIAL not in text:
            return fast.encode_ordinary(text)
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(at("byte_bpe_50k.json")))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


_PIECES = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(capacity: int, folder: str | None):
    def run(batches):
        encode = encoder(folder)
        for batch in batches:
            ids, copies = batch["doc_id"], batch["copy"]
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for doc, copy, text in zip(ids.slice(at, 256).to_pylist(), copies.slice(at, 256).to_pylist(), batch["text"].slice(at, 256).to_pylist(), strict=True):
                    tokens = encode(text or "")
                    tokens.append(0)
                    packed = np.array(tokens, "<u4").tobytes()
                    first = len(tokens) % capacity or capacity
                    cuts = [0, *range(first, len(tokens) + 1, capacity)]
                    out += [(doc, copy, k, a, b - a, zlib.crc32(packed[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """doc_id, copy, piece, start, length, ids_crc32. copy tells rows of one doc_id apart, by task and row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("copy"))
    return in_batches(rows, _cut(capacity, folder), "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(items of each size, times) that use at most `counts`, by column generation rounded down."""
    k = len(sizes)
    need = np.array(counts, float)
    base = np.zeros((k, k))
    for i, s in enumerate(sizes):
        base[i, i] = capacity // s
    level = need / np.diag(base)
    for _ in range(40 * k):
        price = np.linalg.solve(base.T, np.ones(k))
        best, choices = np.zeros(capacity + 1), []
        for _ in range(capacity // min(sizes)):  # one more item each time
            better, choice = best.copy(), np.full(capacity + 1, -1)
            for i, s in enumerate(sizes):
                with_it = best[: capacity + 1 - s] + price[i]
                gain = with_it > better[s:] + 1e-12
                better[s:][gain], choice[s:][gain] = with_it[gain], i
            best = better
            choices.append(choice)
        if best[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), capacity
        for choice in reversed(choices):
            if choice[c] >= 0:
                i = int(choice[c])
                column[i] += 1
                c -= sizes[i]
        move = np.linalg.solve(base, column)
        ratio = np.where(move > 1e-9, level / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        level = level - ratio[out] * move
        level[out] = ratio[out]
        base[:, out] = column
    found = []
    left = np.array(counts)
    for j in np.argsort(-level):
        items = np.round(base[:, j]).astype(int)
        used = items > 0
        times = int(min(np.floor(level[j] + 1e-6), *(left[used] // items[used])))
        if times > 0:
            found.append((items, times))
            left = left - times * items
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> pd.DataFrame:
    """Runs (length, rank_from, rank_to, sequence, offset): ranks a..b-1 of a length go to sequences `sequence`.. one each, at `offset`."""
    small = max(1, capacity // 8) if small is None else small
    runs: list[tuple[int, int, int, int, int]] = []
    taken = dict.fromkeys(histogram, 0)
    fresh = 0
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, how many)]

    def give_room(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            open_runs.setdefault(room, []).append((first, n))

    # 1. groups of equal cardinality over the large lengths, longest first; each holds (length, count) steps
    large = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if s > small and histogram[s]]
    total = sum(n for _, n in large)
    cuts = [round(total * (g + 1) / groups) for g in range(groups)]
    grouped: list[list[tuple[int, int]]] = [[] for _ in range(groups)]
    seen, g = 0, 0
    for s, n in large:
        while n:
            while cuts[g] <= seen:
                g += 1
            part = min(n, cuts[g] - seen)
            grouped[g].append((s, part))
            seen, n = seen + part, n - part
    grouped = [x for x in grouped if x]
    merged: list[list[tuple[int, int]]] = []  # one size a group: groups with one longest length are one
    for x in grouped:
        if merged and merged[-1][0][0] == x[0][0]:
            merged[-1] += x
        else:
            merged.append(x)
    sizes, counts = [x[0][0] for x in merged], [sum(n for _, n in x) for x in merged]

    def take(group: int, n: int) -> list[tuple[int, int]]:
        """The next n actual lengths of a group, as (length, how many)."""
        out = []
        while n:
            s, have = merged[group][0]
            part = min(n, have)
            out.append((s, part))
            n -= part
            if part == have:
                merged[group].pop(0)
            else:
                merged[group][0] = (s, have - part)
        return out

    def place(length: int, first: int, n: int, offset: int) -> None:
        runs.append((length, taken[length], taken[length] + n, first, offset))
        taken[length] += n

    # 2 and 3. configurations over the rounded sizes, then actual lengths in their places
    for items, times in configurations(sizes, counts, capacity) if sizes else []:
        states = [(fresh, times, 0)]  # (first sequence, how many, filled)
        fresh += times
        for group in np.flatnonzero(items):
            for _ in range(items[group]):
                after, lengths = [], take(int(group), times)
                at = 0
                for first, n, filled in states:
                    while n:
                        s, have = lengths[at]
                        part = min(n, have)
                        place(s, first, part, filled)
                        after.append((first, part, filled + s))
                        first, n = first + part, n - part
                        lengths[at] = (s, have - part)
                        at += part == have
                states = after
        for first, n, filled in states:
            give_room(capacity - filled, first, n)

    # 4. what is left, best-fit decreasing by actual length
    rest: dict[int, int] = {}
    for x in merged:
        for s, n in x:
            rest[s] = rest.get(s, 0) + n
    for s, n in histogram.items():
        if s <= small and n:
            rest[s] = rest.get(s, 0) + n
    has = np.zeros(capacity + 1, bool)
    has[list(open_runs)] = True

    def open_new(s: int, each: int, n: int) -> None:
        nonlocal fresh
        if each and n:
            for k in range(each):
                place(s, fresh, n, k * s)
            give_room(capacity - each * s, fresh, n)
            has[capacity - each * s] = each * s < capacity
            fresh += n

    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n and has[s:].any():
            room = s + int(np.argmax(has[s:]))  # the tightest room that takes it
            first, have = open_runs[room].pop()
            part = min(n, have)
            place(s, first, part, capacity - room)
            n -= part
            give_room(room, first + part, have - part)
            has[room] = bool(open_runs[room])
            give_room(room - s, first, part)
            has[room - s] |= room > s
        each = capacity // s
        open_new(s, each, n // each)
        open_new(s, n % each, 1)
    return pd.DataFrame(runs, columns=["length", "rank_from", "rank_to", "sequence", "offset"])


def _placing(runs: pd.DataFrame):
    runs = runs.sort_values(["length", "rank_from"]).reset_index(drop=True)
    lengths, starts = runs["length"].to_numpy(), runs["rank_from"].to_numpy()
    key = lengths.astype(np.int64) << np.int64(44) | starts

    def run(batches):
        for batch in batches:
            rank, length = batch["rank"].to_numpy(), batch["length"].to_numpy()
            at = np.searchsorted(key, (length << np.int64(44)) | rank, side="right") - 1
            sequence = runs["sequence"].to_numpy()[at] + rank - starts[at]
            columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(runs["offset"].to_numpy()[at], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, folder: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs."""
    cut = checkpoint(pieces(docs, capacity, folder))
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if not histogram:
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ranked = positions(cut, ["length"], [F.col("doc_id"), F.col("piece"), F.col("copy")], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(256)), "rank")
    return in_batches(ranked, _placing(plan(histogram, capacity, groups)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
