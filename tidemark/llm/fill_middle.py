"""Fill-in-the-middle: documents cut at line ends into prefix, middle and suffix, and put in another order.

The ends of a text's lines are a boundary set: the byte offset of each line's last byte, in containers of 65,536 offsets. A container
is a sorted array, a bitmap or a list of runs, whichever is smallest, and the set keeps cumulative cardinalities, so the end of line
k is found by a search over containers and a select inside one. A text is looked at one container's bytes at a time; beside the
text itself a task holds the containers, never more than one bit a byte.

Defined cases: null text is empty; a null doc_id counts as an empty number; rows that repeat a doc_id are cut by the same hashes, each
in its own text; texts that hold a marker stay plain, so every output can be taken apart again; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed, percentage of documents that are cut, and percentage of those with the suffix in front.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
SPAN = 1 << 16


class Values:
    """A container of few values: sorted 16-bit numbers."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bits:
    """A container of many scattered values: 1,024 words, with the number of bits before each."""

    def __init__(self, low: np.ndarray):
        marks = np.zeros(SPAN, np.uint8)
        marks[low] = 1
        self.bits = np.packbits(marks, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits.view(np.uint64)), dtype=np.int64)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.bits[8 * word : 8 * word + 8], bitorder="little"))
        return 64 * word + int(inside[k - self.before[word]])


class Runs:
    """A container of values that stand in runs: their first values, with the number of values before each."""

    def __init__(self, low: np.ndarray):
        heads = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.first, self.before = low[heads].astype(np.uint16), heads.astype(np.int64)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> Values | Bits | Runs:
    """The smallest of the three: 2 bytes a value, 8,192, or 4 a run."""
    runs = int(np.count_nonzero(np.diff(low) != 1)) + 1
    if 4 * runs < min(2 * len(low), SPAN // 8):
        return Runs(low)
    return Values(low) if 2 * len(low) <= SPAN // 8 else Bits(low)


class Boundaries:
    """The set of the offsets of the last bytes of a text's lines."""

    def __init__(self, text: np.ndarray):
        self.high, self.held, sizes = [], [], [0]
        for at in range(0, len(text), SPAN):
            part = text[at : at + SPAN]
            low = np.flatnonzero(part == 10)
            if at + len(part) == len(text) and part[-1] != 10:
                low = np.append(low, len(part) - 1)
            if len(low):
                self.high.append(at)
                self.held.append(container(low))
                sizes.append(len(low))
        self.before = np.cumsum(sizes)

    def __len__(self) -> int:
        return int(self.before[-1])

    def after(self, k: int) -> int:
        """The offset at which the first k lines end."""
        if k == 0:
            return 0
        at = int(np.searchsorted(self.before, k - 1, "right")) - 1
        return self.high[at] + self.held[at].select(k - 1 - int(self.before[at])) + 1


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def cut(text: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of lines, form, code points of prefix and of middle, output."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    ends = Boundaries(np.frombuffer(text, np.uint8))
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
    if not text or any(x in text for x in (p, s, m)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (ends.after(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    first, middle, last = text[:a], text[a:b], text[b:]
    chars = len(first.decode()), len(middle.decode())
    if h4 % 100 < suffix_first:
        return n, "spm", *chars, b"".join((s, last, p, first, m, middle))
    return n, "psm", *chars, b"".join((p, first, s, last, m, middle))


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            rows = [cut(text.as_buffer().to_pybytes(), i, seed, rate, suffix_first) for i, text in zip(ids, batch["text"], strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([ids, *columns], schema.types, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return in_batches(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: the markers stand at their first places, as no cut text holds one."""
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substring(output, F.length(head) + len(MIDDLE) + 1, F.length(output))
    inner = F.substring(head, F.lit(len(PREFIX) + 1), F.length(head))
    inside = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    lead = F.when(form == "psm", F.substring_index(inner, SUFFIX, 1)).otherwise(F.substring_index(inner, PREFIX, 1))
    rest = F.substring(inner, F.length(lead) + F.length(inside) + 1, F.length(inner))
    return F.when(form == "plain", output).when(form == "psm", F.concat(lead, middle, rest)).otherwise(F.concat(rest, middle, lead))


_HASH = "('0x' || substr(h, {}, 8))::BIGINT"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS parts, {_HASH.format(1)} AS h1, {_HASH.format(9)} AS h2, {_HASH.format(17)} AS h3, {_HASH.format(25)} AS h4 FROM d),
c AS (SELECT *, len(parts) AS n, least(h1 % (len(parts) + 1), h2 % (len(parts) + 1)) AS a, greatest(h1 % (len(parts) + 1), h2 % (len(parts) + 1)) AS b FROM u),
s AS (SELECT *, coalesce(array_to_string(parts[1:a], ''), '') AS p, coalesce(array_to_string(parts[a + 1:b], ''), '') AS m, coalesce(array_to_string(parts[b + 1:], ''), '') AS z,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || z || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || z || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s"""
