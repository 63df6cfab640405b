"""MinHash near-dedup with HyperMinHash registers.

Each distinct shingle set keeps REGISTERS minimum hashes, compressed to 16 bits: the count of leading zeros and the
first mantissa bits. Bands of ROWS registers are hashed; sets that share a band are candidates. A candidate pair goes on
if its Jaccard similarity, estimated from equal registers with the expected chance collisions taken off, comes near
the threshold, and is then confirmed on full sets.

Inside a band's bucket every set is paired with the bucket's smallest id only, so the pairs grow with the rows and not
with the square of a group. That alone could miss a link between two sets that do not resemble the smallest one, so a
second round takes every bucket whose members still lie in different components and compares those outside the bucket's
main component with all its members, in blocks of bounded size, on full sets where the estimate leaves a link possible;
only confirmed links become rows. No candidate pair between components stays untried. Equal sets are one
class from the start and copies are never expanded into pairs.

Defined cases: null or blank texts have no shingles and are linked with nothing; a text of fewer words than a shingle
has its whole word sequence as one shingle; a null doc_id belongs to the class of an equal set with an id, else it stays
alone with a null component_id; rows that repeat a doc_id are one document with several rows and share its component; an empty table
gives an empty result; other columns are ignored by `classes` and carried by `dedup`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, in_batches, text_or_empty, written
from .graph import components, merged
from .words import U, blocks, hashed_words, mix, separators, shingles

BANDS, ROWS, MANTISSA = 32, 5, 10
REGISTERS = BANDS * ROWS
#: Standard deviations of the estimate by which a pair may fall short of the threshold and still be confirmed.
SLACK = 5.0
#: Members of a block where buckets of several components are compared.
BLOCK = 128
#: Bytes of text that a task shingles at once.
BLOCK_BYTES = 1 << 19

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """16-bit registers: leading zeros of the minimum of each permutation, then its mantissa."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    h = (hashes >> U(32)).astype(np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(low, ((h[None, i : i + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=low)
    fraction, exponent = np.frexp(low.astype(np.float64))
    mantissa = np.floor((fraction - 0.5) * (2 << MANTISSA))
    return np.where(low == 0, 32 << MANTISSA, ((32 - exponent) << MANTISSA) + mantissa.astype(np.int64)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    out = np.full(BANDS, 1, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out * U(0x9E3779B97F4A7C15) + regs.reshape(BANDS, ROWS)[:, j])
    return out.view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of the registers of disjoint sets of n and m elements that agree by chance, as two minima fall into one cell.

    Minima are close to exponential with rates n and m; the cells of z leading zeros are 2^-(z+1) wide in 2^MANTISSA parts.
    """
    rate, total = n + m, np.zeros(len(n))
    for z in range(32):
        low = 2.0 ** -(z + 1)
        total += n * m * low / (1 << MANTISSA) * (np.exp(-rate * low) - np.exp(-rate * 2 * low)) / rate
    return total


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("regs", pa.binary())])


def _signing(k: int):
    def sign(batches):
        sep = separators()
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            for i, j, data, offsets in blocks(texts, BLOCK_BYTES):
                words, _, _, first = hashed_words(data, offsets, sep)
                sets = shingles(words, first, k)
                sigs = [(np.array([s.sum(dtype=np.uint64), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes() if len(s) else None) for s in sets]
                regs = [(registers(s).tobytes() if len(s) else None) for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(regs, pa.binary())], schema=_SIGNED)

    return sign


def signed(docs: DataFrame, k: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, _signing(k), "doc_id long, n_shingles long, sig binary, regs binary")


def _sets(k: int):
    def run(batches):
        sep = separators()
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            for i, j, data, offsets in blocks(texts, BLOCK_BYTES):
                words, _, _, first = hashed_words(data, offsets, sep)
                sets = shingles(words, first, k)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), values], names=["id", "shingles"])

    return run


def _banded(batches):
    for batch in batches:
        regs = np.frombuffer(b"".join(batch["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = np.concatenate([band_keys(r) for r in regs]) if len(regs) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch["id"].to_numpy(), BANDS))], names=["key", "id"])


def _likely(threshold: float):
    """Pairs whose corrected estimate comes within SLACK standard deviations of the threshold."""

    def run(batches):
        for batch in batches:
            n, m = batch["na"].to_numpy().astype(float), batch["nb"].to_numpy().astype(float)
            left = np.frombuffer(b"".join(batch["ra"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            right = np.frombuffer(b"".join(batch["rb"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            share = (left == right).mean(axis=1)
            by_chance = chance(n, m)
            estimate = (share - by_chance) / (1 - by_chance)
            may = estimate >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS)
            may &= np.minimum(n, m) >= threshold * np.maximum(n, m)  # no smaller ratio of sizes can reach the threshold
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(may))

    return run


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids with 100 * intersection >= percent * union of full shingle sets."""
    one = classes.select("id", "n_shingles", "regs")
    with_a = pairs.join(one.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra")), "a")
    with_b = with_a.join(one.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb")), "b")
    likely = written(in_batches(with_b, _likely(percent / 100), "a long, b long"))
    joined = likely.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return joined.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the rows of docs whose doc_id is among ids. Ids and texts meet in a shuffle, whatever their number."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(ids.select(F.col("id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    return checkpoint(in_batches(met, _sets(k), "id long, shingles array<long>"))


def _near(x: int, outs: list[dict], rx: np.ndarray, members: tuple, key: int, threshold: float) -> np.ndarray:
    """Members that outsider x may link to by the estimate: in another component, in this band as their first common one."""
    ids, components_, inside, sizes, regs = members
    me = outs[x]
    may = (components_ != me["component"]) & (inside | (ids > me["id"])) & (np.minimum(sizes, me["n_shingles"]) >= threshold * np.maximum(sizes, me["n_shingles"]))
    at = np.flatnonzero(may)
    if not len(at):
        return at
    equal = regs[at] == rx[x]
    c = chance(np.full(len(at), float(me["n_shingles"])), sizes[at])
    ok = (equal.mean(axis=1) - c) / (1 - c) >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    at, equal = at[ok], equal[ok]
    here = int(np.flatnonzero(band_keys(rx[x]) == key)[0])
    return at[equal.reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1) == here] if len(at) else at


def _columns(rows: list[dict]) -> tuple:
    regs = np.frombuffer(b"".join(r["regs"] for r in rows), np.uint16).reshape(-1, REGISTERS)
    return np.array([r["id"] for r in rows]), np.array([r["component"] for r in rows]), np.array([r["inside"] for r in rows]), np.array([r["n_shingles"] for r in rows], float), regs


def _possible(threshold: float):
    """(key, id) of the sets that have a possible link across components in this bucket."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, outs, rows = (batch[c][i].as_py() for c in ("key", "outs", "members"))
                members, rx, found = _columns(rows), _columns(outs)[-1], set()
                for x in range(len(outs)):
                    at = _near(x, outs, rx, members, key, threshold)
                    if len(at):
                        found.add(outs[x]["id"])
                        found.update(members[0][at].tolist())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())], names=["key", "id"])

    return run


def _linking(threshold: float, percent: int):
    """Links (a, b) confirmed on full sets, one for each outsider and other component in a pair of blocks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, outs, rows = (batch[c][i].as_py() for c in ("key", "outs", "members"))
                members, rx = _columns(rows), _columns(outs)[-1]
                sets = [np.array(r["shingles"], np.int64) for r in rows]
                left, right = [], []
                for x in range(len(outs)):
                    mine = np.sort(np.array(outs[x]["shingles"], np.int64))
                    linked_to = set()
                    for j in _near(x, outs, rx, members, key, threshold):
                        if members[1][j] in linked_to:
                            continue
                        place = np.searchsorted(mine, sets[j])
                        both = int((mine[np.minimum(place, len(mine) - 1)] == sets[j]).sum())
                        if 100 * both >= percent * (len(mine) + len(sets[j]) - both):
                            linked_to.add(members[1][j])
                            left.append(min(outs[x]["id"], rows[j]["id"]))
                            right.append(max(outs[x]["id"], rows[j]["id"]))
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _blocks(places: DataFrame, sets: DataFrame, fields: list[str]) -> DataFrame:
    """key, outs, members: pairs of blocks of about BLOCK outsiders and BLOCK members of a bucket, with their fields of sets.

    The places (key, id, component, inside) are numbered and filtered while narrow; registers and sets join them last.
    """
    sizes = places.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("inside")).alias("u"))
    sized = places.join(written(sizes.where("u > 0")), "key")

    def gathered(rows: DataFrame, n: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col(n) / BLOCK))
        return checkpoint(rows.join(sets, "id").groupBy("key", block.alias("block")).agg(F.collect_list(F.struct(*fields)).alias(name)).drop("block"))

    return gathered(sized.where(~F.col("inside")), "u", "outs").join(gathered(sized, "n", "members"), "key")


def between(held: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of mixed buckets: all outside the main one against all members, block by block.

    Blocks have about BLOCK members whatever the bucket's size, and a row of the join is a pair of blocks, never a pair of
    sets. Registers alone first tell which sets have a possible link; only these fetch their full sets for the second pass,
    which makes rows of confirmed links only.
    """
    fields = ["id", "component", "inside", "n_shingles", "regs"]
    signs = written(classes.select("id", "n_shingles", "regs").join(held.select("id").distinct(), "id", "left_semi"))
    possible = written(in_batches(_blocks(held, signs, fields), _possible(percent / 100), "key long, id long").distinct())
    places = held.join(possible, ["key", "id"], "left_semi")
    full = signs.join(possible.select("id").distinct(), "id", "left_semi").join(sets, "id")
    return in_batches(_blocks(places, full, [*fields, "shingles"]), _linking(percent / 100, percent), "a long, b long").distinct()


def mixed(buckets: DataFrame, reach: DataFrame) -> DataFrame:
    """key, id, component, inside for the buckets whose members lie in several components: inside their largest part or not."""
    where = buckets.join(reach, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = where.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("main.component").alias("main"))
    main = written(main)  # a table of its own leaves Spark free to split a hot bucket in the join
    return written(where.join(main, "key").select("key", "id", "component", (F.col("component") == F.col("main")).alias("inside")))


def linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, id of the row's class; reach: id, component of the classes that have links)."""
    rows = written(signed(docs, k))
    classes = written(rows.where("n_shingles > 0 and doc_id is not null").groupBy("sig", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("regs").alias("regs")))
    members = rows.select("doc_id", "n_shingles", "sig").join(classes.select("sig", "n_shingles", "id"), ["sig", "n_shingles"], "left").select("doc_id", "n_shingles", "id")

    keys = in_batches(classes.select("id", "regs"), _banded, "key long, id long")
    heads = written(keys.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head"))
    buckets = written(keys.join(heads, "key"))
    sets = full_sets(docs, written(buckets.select("id").distinct()), k)
    first = buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = written(confirmed(first, classes, sets, percent))
    reach = components(links)

    # What is left in buckets of several components is compared in blocks, so that no link between components is missed.
    held = mixed(buckets, reach)
    if not held.isEmpty():
        more = written(between(held, classes, sets, percent))
        if not more.isEmpty():
            reach = merged(reach, more)
    return members, reach


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, for every row of docs."""
    members, reach = linked(docs, k, percent)
    out = members.join(reach, "id", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each component, the one with the smallest doc_id.

    Of rows that repeat a kept doc_id each different text stays once; rows without a doc_id all stay, each different text once.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key, copy = fresh(docs, "key"), fresh(docs, "copy")
    kept = classes(docs, k, percent).where("kept").select(name.alias(key)).distinct()
    keyed = docs.withColumn(key, name)
    one = keyed.join(kept, key, "left_semi").withColumn(copy, F.row_number().over(Window.partitionBy(key, F.sha2(text_or_empty(), 256)).orderBy(key)))
    return one.where(F.col(copy) == 1).drop(key, copy)
