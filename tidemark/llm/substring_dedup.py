"""Substring dedup by sliding spans of sentences.

A text is cut into sentences (at words with . ! or ? and at line ends). From every sentence a span runs over at least
`sentences` sentences and `words` words, on to the first sentence end at which it has both. Spans are hashed on their words,
white space and the case of A-Z aside, and met globally: of equal spans, the one in the smallest (doc_id, sentence) is the first,
and the sentences that any other one covers are removed. Counts are taken per hash before anything is joined, and only
hashes that repeat come back. The counts and the first places are tables of their own before they meet the spans, so that
Spark can split the hash of a passage that a third of all documents share over many tasks.

With inside=True sentences are also cut at the pair of words with the least hash of each CUT pairs
in a row. Such cuts hang on at most CUT words around them, so that copies of a passage that begins or ends in the middle of
different sentences are cut alike from CUT words after its start. Every run of 24 + 3 * CUT words that two documents share
then has a common span; at each end up to CUT words of it, or up to the next cuts, stay. The registered query does so.

Defined cases: null text stays null; texts too short for a span never change; a null doc_id comes after all others; rows
that repeat a doc_id, also null, are told apart by a 64-bit hash of their text, and equal rows change alike; a span that repeats inside one
document is removed at its later places; an empty table gives an empty result; other columns are carried by `cleaned`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, in_batches, text_or_empty, written
from .words import U, blocks, hashed_words, mix, separators

#: Sentences and words that a span has at least, and pairs of words of which one is cut with inside=True.
SENTENCES, WORDS, CUT = 3, 24, 6
_Q = U(0xD6E8FEB86659FD93)


def _least_pairs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each CUT pairs of neighbouring words in a row inside one text, the one with the least hash, the last of equals."""
    pairs = mix(words[:-1] * _Q + words[1:])
    m = max(len(pairs) - CUT + 1, 0)
    least, at = pairs[:m].copy(), np.arange(m)
    for k in range(1, CUT):
        here = pairs[k : k + m] <= least
        least[here], at[here] = pairs[k : k + m][here], np.flatnonzero(here) + k
    text = np.searchsorted(first, np.arange(len(words)), side="right")
    return np.unique(at[text[:m] == text[CUT : CUT + m]])


def _units(data: np.ndarray, offsets: np.ndarray, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word starts, word ends, first word of each unit and one more, first unit of each text and one more)."""
    words, starts, ends, first = hashed_words(data, offsets, separators())
    n = len(words)
    stop = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 46) | (data == 33) | (data == 63), out=stop[1:])
    line = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=line[1:])
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    if n:
        begins[1:n] |= stop[ends[:-1]] > stop[starts[:-1]]
        begins[1:n] |= line[starts[1:]] > line[ends[:-1]]
    if n and inside:
        begins[_least_pairs(words, first) + 1] = True
    unit = np.flatnonzero(begins)
    return words, starts, ends, unit, np.searchsorted(unit, first)


def _spans(words: np.ndarray, unit: np.ndarray, of_text: np.ndarray, least: tuple[int, int] = (SENTENCES, WORDS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first unit, unit after the last, hash) of every span."""
    n = len(unit) - 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.maximum(np.arange(n) + least[0], np.searchsorted(unit, unit[:-1] + least[1], side="left"))
    text_end = of_text[np.searchsorted(of_text, np.arange(n), side="right")]
    ok = last <= text_end
    a, b = np.flatnonzero(ok), last[ok]
    # sum of h * Q^i up to each word gives the sum over any run; dividing by Q^first makes it the same wherever it stands
    total = len(words)
    power = np.full(total + 1, int(_Q), np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(total + 1, pow(int(_Q), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)])
    x, y = unit[a], unit[b]
    return a, b, mix((upto[y] - upto[x]) * inverse[x] + (y - x).astype(np.uint64))


def _spanning(inside: bool, least: tuple[int, int]):
    def run(batches):
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            for i, j, data, offsets in blocks(texts, 1 << 19):
                words, _, _, unit, of_text = _units(data, offsets, inside)
                a, b, h = _spans(words, unit, of_text, least)
                text = np.searchsorted(of_text, a, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), ids.take(pa.array(i + text)), batch["text_hash"].take(pa.array(i + text)), pa.array((a - of_text[text]).astype(np.int32)), pa.array((b - a).astype(np.int32))],
                    names=["hash", "doc_id", "text_hash", "sentence", "sentences"],
                )

    return run


def covered(docs: DataFrame, inside: bool = False, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, spans (sentence, sentences), first_ids: the non-first spans of each document that has any, and documents with their first ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(text_or_empty()).alias("text_hash"))
    every = in_batches(rows, _spanning(inside, (sentences, words)), "hash long, doc_id long, text_hash long, sentence int, sentences int")
    # places are met only for hashes that repeat, so that the first shuffle of all spans moves their hashes alone
    repeated = written(every.groupBy("hash").count().where("count > 1").select("hash"))
    spans = written(every.join(repeated, "hash"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "sentence")
    firsts = written(spans.groupBy("hash").agg(F.min(place).alias("first")))
    later = spans.join(firsts, "hash").where(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("sentence", "sentences")).alias("spans"), F.collect_set("first.doc_id").alias("first_ids"))


def _cut(text: str, spans: list[dict], inside: bool) -> tuple[str, int, int, int, int]:
    """(text without the covered sentences, sentences, removed sentences, removed words, removed characters)."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words, starts, ends, unit, _ = _units(data, np.array([0, len(data)]), inside)
    n = len(unit) - 1
    gone = np.zeros(n + 1, np.int64)
    for s in spans:
        gone[s["sentence"]] += 1
        gone[s["sentence"] + s["sentences"]] -= 1
    gone = np.cumsum(gone)[:n] > 0
    # a sentence reaches to the start of the next one, so that its white space goes with it
    edges = np.append(starts[unit[:n]], len(data)) if n else np.array([len(data)])
    raw = data.tobytes()
    kept = [raw[: edges[0]]] + [raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone)]
    out = b"".join(kept).decode("utf-8")
    size = np.diff(unit)
    return out, n, int(gone.sum()), int(size[gone].sum()), len(text) - len(out)


def _cutting(names: list[str], spans: str, counts: list[str], inside: bool):
    """Batches of the columns `names`, texts cut, and of the four counts of `_cut`."""

    def run(batches):
        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                done += [_cut(t, s, inside) if s and t is not None else (t, None, 0, 0, 0) for t, s in zip(some["text"].to_pylist(), some[spans].to_pylist(), strict=True)]
            columns = [pa.array([d[0] for d in done], pa.string()) if c == "text" else batch[c] for c in names]
            more = [pa.array([d[k] for d in done], pa.int64()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*names, *counts])

    return run


def _cleared(docs: DataFrame, how: str, inside: bool, least: tuple[int, int]) -> tuple[DataFrame, str, list[str]]:
    """(docs with the covered sentences cut from their texts, beside the ids of first copies and four counts; names of these columns)."""
    key, text_hash, spans, first, *counts = (fresh(docs, n) for n in ("found_id", "found_hash", "spans", "first_ids", "n_sentences", "removed_sentences", "removed_words", "removed_chars"))
    found = checkpoint(covered(docs, inside, *least)).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("spans").alias(spans), F.col("first_ids").alias(first))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text_or_empty()) == F.col(text_hash))
    met = docs.join(found, same, how).drop(key, text_hash)
    names = [*docs.columns, first]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.drop(spans).schema)
    return in_batches(met.select(*[f"`{c}`" for c in names], spans), _cutting(names, spans, counts, inside), schema + "".join(f", `{c}` long" for c in counts)), first, counts


def changed(docs: DataFrame, inside: bool = False, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """One row for each document that loses sentences: doc_id, n_sentences, removed_sentences, removed_words, removed_chars, first_doc_ids, text (what remains)."""
    out, first, counts = _cleared(docs.select("doc_id", "text"), "inner", inside, (sentences, words))
    return out.select("doc_id", *counts, F.array_sort(first).alias("first_doc_ids"), "text")


def cleaned(docs: DataFrame, inside: bool = False, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """docs with the covered sentences removed from their texts; documents of which nothing stays have an empty text."""
    return _cleared(docs, "left", inside, (sentences, words))[0].select(*[f"`{c}`" for c in docs.columns])
