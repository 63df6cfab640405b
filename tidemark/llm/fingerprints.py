"""Document fingerprints from Lempel-Ziv phrases.

A document is parsed into dictionary phrases: each is the longest phrase met before plus one code point. The phrase set
is hashed, and a signature keeps the minimum hash of each of SLOTS bins, eight bits of it; empty bins borrow from the
next full one. Equal slots, with the chance agreement of eight bits taken off, estimate the share of common phrases,
which like a compressor's gain is high when one text's phrases help to write the other.

`compared` sets each document beside its edited text (the end replaced by the beginning of the next document) and beside
the next document, in descending order of doc_id. The rows are dealt by ranges of doc_id, each range with the head of
the range that follows, so one shuffle of the texts is enough and no task sees more than its range; both parses share
the part that the edit leaves alone.

Defined cases: null text is empty; an empty text has the empty fingerprint, likeness 1 to an empty one and 0 to others;
a null doc_id comes last in the order, rows that repeat a doc_id follow each other by text; a lone document is its own
next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, text_or_empty
from .words import U, mix, segment_hash

SLOTS = 128


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64) + U(1)) | U(1)


def parse(seen: dict[str, None], phrase: str, text: str) -> str:
    """Goes on parsing: adds phrases to seen, returns the phrase begun at the end."""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen[phrase] = None
            phrase = ""
    return phrase


def signature(seen: dict[str, None], text: str) -> np.ndarray:
    """The minimum-hash signature of the phrases of text, which are its consecutive parts."""
    if not text:
        return np.zeros(0, np.uint8)
    lengths = np.fromiter(map(len, seen), np.int64, len(seen))
    starts = np.cumsum(lengths) - lengths
    values = _codes()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")[: int(lengths.sum())]]
    h = segment_hash(values, starts)
    slot = (h >> U(57)).astype(np.int64)
    low = np.full(SLOTS, np.iinfo(np.uint64).max)
    np.minimum.at(low, slot, h << U(7))
    full = np.zeros(SLOTS, bool)
    full[slot] = True
    at = np.flatnonzero(full)
    source = at[np.searchsorted(at, np.arange(SLOTS)) % len(at)]  # itself, or the next full one round the circle
    far = (source - np.arange(SLOTS)) % SLOTS
    return (mix(low[source] + far.astype(np.uint64)) >> U(56)).astype(np.uint8)


def fingerprint(text: str) -> np.ndarray:
    seen: dict[str, None] = {}
    parse(seen, "", text)
    return signature(seen, text)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return max(0.0, (float((a == b).mean()) - 1 / 256) / (1 - 1 / 256))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches):
    """Rows in order, a head at the end of each range: a row is done when the next one is known."""
    held: dict | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            out: list[tuple] = []
            cut = batch.slice(at, 200)
            for doc, text, head in zip(cut["doc_id"].to_pylist(), cut["text"].to_pylist(), cut["head"].to_pylist(), strict=True):
                n = len(text)
                keep = n - n // 2
                seen: dict[str, None] = {}
                phrase = parse(seen, "", text[:keep])
                before = None if head else dict(seen)
                parse(seen, phrase, text[keep:])
                mine = signature(seen, text)
                if held is not None:
                    edited = held["text"][: held["keep"]] + text[: held["n"] // 2]
                    parse(held["seen"], held["phrase"], text[: held["n"] // 2])
                    sign = signature(held["seen"], edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                    out.append((held["doc"], held["n"], sha, held["sign"].tobytes().hex(), sign.tobytes().hex(), likeness(held["sign"], sign), likeness(held["sign"], mine)))
                held = None if head else {"doc": doc, "text": text, "n": n, "keep": keep, "seen": before, "phrase": phrase, "sign": mine}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)


def compared(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 3 * parts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", steps, 10_000).alias("b")).first()["b"] or [])) if steps else []
    above = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(above))
    order = F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id")).alias("down"), "text")
    heads = rows.groupBy("range").agg(F.min(order).alias("head"))  # one row a range
    line = Window.orderBy("range")
    after = F.coalesce(F.lead("head").over(line), F.first("head").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = heads.select(F.lit(None).cast("long").alias("doc_id"), after.getField("text").alias("text"), "range", F.lit(True).alias("head"))
    dealt = rows.withColumn("head", F.lit(False)).unionByName(ends).repartition(parts, "range")
    dealt = dealt.sortWithinPartitions("range", "head", F.col("doc_id").desc_nulls_last(), "text")
    return in_batches(dealt.select("doc_id", "text", "head"), _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
