"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

A snapshot's digests are grouped into buckets by their first bits, so many that a bucket holds about KEYS_PER_BUCKET
digests whatever the snapshot's size, and each bucket gets a static 3-wise binary-fuse filter of 16-bit fingerprints.
The duplicates inside the incoming batch are grouped first, on their own; what is left, one row a digest, is screened by
the filter of its bucket. Only positives join the snapshot's exact buckets, on all 32 bytes of the digest and the
length, and what meets there is compared byte by byte: one normalised text of either side; negatives are certainly new.
Buckets are as many as the larger side needs, so that a first batch beside an empty snapshot is spread as well.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty. Of
equal texts the row with most code points stays, then the smallest doc_id. A null doc_id comes after every other. Rows
that repeat a doc_id with an equal text all count in group_size; one of them is kept. An empty table gives an empty
result. Other columns, whatever their names, are carried through by `dedup` and ignored by `decisions`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, checkpoint, fresh, text_or_empty, written
from .words import U, mix

KEYS_PER_BUCKET = 100_000
SLOTS = 1 << 24


def normalised() -> Column:
    return F.regexp_replace(text_or_empty(), f"[{WS}]+", "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def digests(docs: DataFrame, hex_digest=sha256) -> DataFrame:
    """doc_id, digest (32 bytes of SHA-256), norm_len (bytes), n_chars, slot (of the digest)."""
    rows = docs.select("doc_id", F.length(text_or_empty()).cast("long").alias("n_chars"), normalised().alias("norm"))
    rows = rows.select("doc_id", "n_chars", F.octet_length("norm").cast("long").alias("norm_len"), hex_digest(F.col("norm")).alias("hex"))
    return rows.select("doc_id", "n_chars", "norm_len", F.unhex("hex").alias("digest"), F.conv(F.substring("hex", 1, 6), 16, 10).cast("int").alias("slot"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: how many rows, and the row that would stay."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus_id")))
    return rows.groupBy("digest", "norm_len", "slot").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))


def _keys(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x[8:16] for x in digest), dtype="<u8").copy() if len(digest) else np.zeros(0, np.uint64)


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray:
    """Three places of each key, in three adjoining segments."""
    with np.errstate(over="ignore"):
        h = mix(keys + U(seed) * U(0x9E3779B97F4A7C15))
    first = (h >> U(32)) * U(segments) >> U(32)
    mask = U(segment - 1)
    return np.stack([(first + U(j)) * U(segment) + ((mix(h + U(j)) if j else h) & mask) for j in range(3)]).astype(np.int64)


def _prints(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ U(0xC2B2AE3D27D4EB4F) + U(seed)) >> U(48)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, fingerprints) for distinct keys, by peeling; another seed where peeling gets stuck."""
    keys = np.unique(keys)
    n = max(len(keys), 1)
    segment = 1 << max(2, min(18, int(math.log(n, 3.33) + 2.25)))
    size = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))) * n
    segments = max(1, math.ceil(size / segment) - 2) + (1 if n < 1000 else 0)
    for seed in range(1, 200):
        places = _places(keys, seed, segment, segments)
        slots = segment * (segments + 2)
        count = np.bincount(places.ravel(), minlength=slots)
        held = np.zeros(slots, np.int64)  # sum of the indices of the keys at a place: the key itself where there is one
        for p in places:
            np.add.at(held, p, np.arange(len(keys)))
        order, left = [], len(keys)
        ready = np.flatnonzero(count == 1)
        while len(ready):
            who, at = np.unique(held[ready], return_index=True)
            spot = ready[at]
            order.append((who, spot))
            left -= len(who)
            touched = places[:, who]
            np.subtract.at(count, touched.ravel(), 1)
            np.subtract.at(held, touched.ravel(), np.tile(who, 3))
            touched = np.unique(touched)
            ready = touched[count[touched] == 1]
        if not left:
            table = np.zeros(slots, np.uint16)
            prints = _prints(keys, seed)
            for who, spot in reversed(order):
                table[spot] = 0
                at = places[:, who]
                table[spot] = prints[who] ^ table[at[0]] ^ table[at[1]] ^ table[at[2]]
            return seed, segment, segments, table
        if seed % 10 == 0:
            segments += max(1, segments // 10)
    raise ValueError("no seed gives a filter")


def maybe_in(filt: tuple[int, int, int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    seed, segment, segments, table = filt
    a, b, c = _places(keys, seed, segment, segments)
    return _prints(keys, seed) == table[a] ^ table[b] ^ table[c]


def filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """bucket, seed, segment, segments, prints: one filter for each bucket of a grouped snapshot, built once a snapshot."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, prints = build_filter(_keys(pdf["digest"]))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [seed], "segment": [segment], "segments": [segments], "prints": [prints.tobytes()]})

    rows = snapshot.select("digest", (F.col("slot") * buckets / SLOTS).cast("int").alias("bucket"))
    return rows.groupBy("bucket").applyInPandas(build, "bucket int, seed long, segment long, segments long, prints binary")


def screened(incoming: DataFrame, filt: DataFrame, buckets: int) -> DataFrame:
    """The grouped incoming rows with `maybe`: whether the snapshot's filter of their bucket takes them for its own."""

    def screen(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(right):
            f = right.iloc[0]
            left["maybe"] = maybe_in((int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["prints"], np.uint16)), _keys(left["digest"]))
        else:
            left["maybe"] = False
        return left[["digest", "maybe"]]

    rows = incoming.select("digest", (F.col("slot") * buckets / SLOTS).cast("int").alias("bucket"))
    return rows.groupBy("bucket").cogroup(filt.groupBy("bucket")).applyInPandas(screen, "digest binary, maybe boolean")


def differing(met: DataFrame, docs: DataFrame, is_old: Column, hex_digest=sha256) -> DataFrame:
    """The digest and norm_len of met (digest, norm_len, best, new_best) whose normalised texts differ in a byte.

    Ids of one row of either side go to the texts in a shuffle, whatever their number; only those texts are normalised.
    """
    side = lambda best, old: met.select("digest", "norm_len", (-F.col(f"{best}.minus_id")).alias("doc_id"), F.lit(old).alias("old"))
    wanted = written(side("best", True).unionByName(side("new_best", False)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    texts = docs.select(name, is_old.alias("old"), text_or_empty().alias("text"))
    texts = texts.join(wanted.select(name, "old").distinct().hint("shuffle_hash"), ["name", "old"], "left_semi")
    norms = texts.select("name", "old", normalised().alias("norm")).select("name", "old", "norm", F.octet_length("norm").cast("long").alias("norm_len"), F.unhex(hex_digest(F.col("norm"))).alias("digest"))
    found = norms.join(wanted.select(name, "old", "norm_len", "digest"), ["name", "old", "norm_len", "digest"], "left_semi")
    # Texts of either side, one for each digest: min and max agree where no byte differs.
    ends = found.groupBy("digest", "norm_len").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    return written(ends.where("a <> b").select("digest", "norm_len"))


def resolved(rows: DataFrame, docs: DataFrame, is_old: Column, hex_digest=sha256) -> DataFrame:
    """digest, norm_len, old, n, best, known (the snapshot held it): one row for each text of either side that holds it."""
    old, new = (written(grouped(rows.where(rule))) for rule in ("old", "not old"))
    buckets = max(1, min(SLOTS, math.ceil(max(old.count(), new.count()) / KEYS_PER_BUCKET)))
    new = new.join(screened(new, filters(old, buckets), buckets), "digest")
    exact = new.where("maybe").select("digest", "norm_len", F.col("n").alias("new_n"), F.col("best").alias("new_best"))
    met = written(old.join(exact, ["digest", "norm_len"]))
    met = met.join(differing(met, docs, is_old, hex_digest), ["digest", "norm_len"], "left_anti")
    met = written(met.select("digest", "norm_len", (F.col("n") + F.col("new_n")).alias("n"), F.greatest("best", "new_best").alias("best"), F.lit(True).alias("known")))
    both = met.withColumn("old", F.explode(F.array(F.lit(True), F.lit(False))))
    alone = [side.join(met.select("digest", "norm_len"), ["digest", "norm_len"], "left_anti").select("digest", "norm_len", "n", "best", F.lit(k).alias("known"), F.lit(k).alias("old")) for side, k in ((old, True), (new, False))]
    return both.unionByName(alone[0]).unionByName(alone[1])


def decisions(docs: DataFrame, is_snapshot: Column | None = None, hex_digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, known for every row of docs.

    is_snapshot is a boolean Column: rows for which it is not true come in as the new batch. By default the even
    doc_ids form the snapshot.
    """
    flag = F.coalesce(F.pmod(F.col("doc_id"), F.lit(2)) == 0 if is_snapshot is None else is_snapshot, F.lit(False))
    old_docs, new_docs = docs.where(flag), docs.where(~flag)
    rows = checkpoint(digests(old_docs, hex_digest).withColumn("old", F.lit(True)).unionByName(digests(new_docs, hex_digest).withColumn("old", F.lit(False))))
    groups = resolved(rows, docs, flag, hex_digest).select("digest", "norm_len", "old", "n", (-F.col("best.minus_id")).alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), "known")
    out = rows.join(written(groups), ["digest", "norm_len", "old"]).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
    first = F.row_number().over(Window.partitionBy("digest", "norm_len", "keep_id", "doc_id", "stays").orderBy("n_chars"))
    out = out.repartition("digest", "doc_id")  # else the window holds the join above to whole digests, and a hot one to one task
    return out.withColumn("copy", F.when(F.col("stays"), first)).select(
        "doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known"
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    key, copy = fresh(docs, "key"), fresh(docs, "copy")
    kept = decisions(docs).where("kept").select(F.concat_ws(":", "text_sha256", "doc_id").alias(key))
    keyed = docs.withColumn(key, F.concat_ws(":", F.sha2(normalised(), 256), F.col("doc_id").cast("string")))
    one = keyed.join(kept, key, "left_semi").withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(F.length(text_or_empty()).desc())))
    return one.where(F.col(copy) == 1).drop(key, copy)
