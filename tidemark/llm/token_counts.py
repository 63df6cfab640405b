"""Edit-aware token counts.

A text is cut into segments of about SEGMENT code points at places where a word ends before white space, or where letters, numbers
and other signs meet; there the tokenizer's pre-tokens end whatever follows, so a segment's tokens depend on the segment alone. A run
of letters without any such place is one pre-token to the tokenizer too, and one segment. A tree keeps, for each
document, the code points and tokens of every segment at its leaves and their sums above.

An edit (start, removed, inserted) finds its segments by descending the tree, re-encodes only those, widened by a
neighbour while the new text would join up across a boundary, and adds the differences to the sums on the paths to the
root; where the number of segments changes, the leaves are spliced and the sums of the rows above are added up again from
counts already known, without encoding anything. Trees are plain arrays, so a table of them can be kept beside the
documents and edited again without reading more than the touched segments.

Defined cases: null text is empty and has no segments and no tokens; an edit's start and length are cut to the text;
edits apply in order, each to the text that the one before left; null edits and null parts of an edit count as none, 0
and empty; the special token's string is ordinary text or special exactly as in `packing.encoder`, and stays in one
segment; rows that repeat a doc_id are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, text_or_empty
from .packing import encoder

SEGMENT = 1024
_SPACE = " \t\n\x0b\x0c\r"


def _kind(char: str) -> str:
    """L letter, N number, or O: what the tokenizer's pattern tells apart beside white space."""
    kind = unicodedata.category(char)[0]
    return kind if kind in "LN" else "O"


def parts(before: str, after: str) -> bool:
    """Whether pre-tokens end between two characters whatever stands around them: before white space, and where letters, numbers and other signs meet.

    An apostrophe may belong to the letters after it.
    """
    if before.isspace() or after.isspace():
        return after in _SPACE and not before.isspace()
    return before != "'" and _kind(before) != _kind(after)


def cuts(text: str, size: int = SEGMENT) -> list[int]:
    """Ends of the segments: after `size` code points at least, where the text parts."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        k = at + size
        while k < n and not parts(text[k - 1], text[k]):
            k += 1
        if k >= n:
            break
        out.append(k)
        at = k
    return out + [n] if n else out


class Tree:
    """Code points and tokens of segments, with sums. rows[0] are the leaves; rows[-1] is the root."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.build(chars, tokens)

    def build(self, chars: list[int], tokens: list[int]) -> None:
        self.rows = [list(zip(chars, tokens, strict=True))]
        while len(self.rows[-1]) > 1:
            low = self.rows[-1]
            self.rows.append([tuple(map(sum, zip(*low[i : i + 2], strict=True))) for i in range(0, len(low), 2)])

    @property
    def chars(self) -> int:
        return self.rows[-1][0][0] if self.rows[0] else 0

    @property
    def tokens(self) -> int:
        return self.rows[-1][0][1] if self.rows[0] else 0

    def find(self, at: int) -> tuple[int, int]:
        """(leaf that holds code point `at`, its first code point); the last leaf for the end."""
        i, before = 0, 0
        for row in reversed(self.rows[:-1]):
            i *= 2
            if at >= before + row[i][0] and i + 1 < len(row):
                before += row[i][0]
                i += 1
        return i, before

    def set(self, i: int, chars: int, tokens: int) -> None:
        """Gives a leaf new counts and adds the difference on its path to the root."""
        dc, dt = chars - self.rows[0][i][0], tokens - self.rows[0][i][1]
        for row in self.rows:
            row[i] = (row[i][0] + dc, row[i][1] + dt)
            i //= 2

    def splice(self, a: int, b: int, leaves: list[tuple[int, int]]) -> None:
        if b - a == len(leaves):
            for i, (c, t) in enumerate(leaves):
                self.set(a + i, c, t)
        else:
            new = self.rows[0][:a] + leaves + self.rows[0][b:]
            self.build([x[0] for x in new], [x[1] for x in new])


def tree_of(text: str, encode) -> Tree:
    ends = cuts(text) if "<|endoftext|>" not in text else ([len(text)] if text else [])
    return Tree([b - a for a, b in zip([0, *ends], ends, strict=False)], [len(encode(text[a:b])) for a, b in zip([0, *ends], ends, strict=False)])


def edit(text: str, tree: Tree, start: int, removed: int, inserted: str, encode) -> tuple[str, int]:
    """(text after the edit, code points re-encoded). The tree is changed in place."""
    start = min(max(start, 0), len(text))
    removed = min(max(removed, 0), len(text) - start)
    after = text[:start] + inserted + text[start + removed :]
    leaves = tree.rows[0]
    if not leaves or "<|endoftext|>" in after or "<|endoftext|>" in text:
        new = tree_of(after, encode)
        tree.rows = new.rows
        return after, len(after)
    a, first = tree.find(start)
    b, last = tree.find(start + removed)
    end = last + leaves[b][0]
    shift = len(inserted) - removed

    def parted(at: int) -> bool:  # whether the text after the edit may be cut here
        return at <= 0 or at >= len(after) or parts(after[at - 1], after[at])

    while a > 0 and not parted(first):
        a -= 1
        first -= leaves[a][0]
    while b + 1 < len(leaves) and not parted(end + shift):
        b += 1
        end += leaves[b][0]
    region = after[first : end + shift]
    ends = cuts(region)
    tree.splice(a, b + 1, [(y - x, len(encode(region[x:y]))) for x, y in zip([0, *ends], ends, strict=False)])
    return after, len(region)


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_segments", pa.int64()), ("n_tokens", pa.int64()), ("edited_chars", pa.int64()), ("edited_tokens", pa.int64()), ("reencoded_chars", pa.int64()),
    ("edited_sha256", pa.string()), ("segment_chars", pa.list_(pa.int32())), ("segment_tokens", pa.list_(pa.int32())),
])


def _counting(folder: str | None):
    def run(batches):
        encode = encoder(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                out = []
                kept = zip(cut["segment_chars"].to_pylist(), cut["segment_tokens"].to_pylist(), strict=True) if "segment_chars" in cut.schema.names else [(None, None)] * cut.num_rows
                for doc, text, edits, (chars, tokens) in zip(cut["doc_id"].to_pylist(), cut["text"].to_pylist(), cut["edits"].to_pylist(), kept, strict=True):
                    tree = Tree(chars, tokens) if chars is not None else tree_of(text, encode)
                    before, n, segments, done = tree.tokens, len(text), len(tree.rows[0]), 0
                    for e in edits or []:
                        if e is not None:
                            text, k = edit(text, tree, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", encode)
                            done += k
                    sha = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
                    leaves = tree.rows[0]
                    out.append((doc, n, segments, before, len(text), tree.tokens, done, sha, [x[0] for x in leaves], [x[1] for x in leaves]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def counted(docs: DataFrame, edits: Column | None = None, folder: str | None = None) -> DataFrame:
    """Counts of every row of docs before and after its edits, and the tree's leaves after them.

    edits: array of struct(start, removed, inserted); none by default. If docs has segment_chars and segment_tokens, the
    leaves that an earlier call returned, those are used and only what the edits touch is encoded.
    """
    none = F.array().cast("array<struct<start:long,removed:long,inserted:string>>")
    trees = [F.col(c).cast("array<int>").alias(c) for c in ("segment_chars", "segment_tokens") if c in docs.columns]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), (none if edits is None else edits.cast("array<struct<start:long,removed:long,inserted:string>>")).alias("edits"), *trees)
    return in_batches(
        rows,
        _counting(folder),
        "doc_id long, n_chars long, n_segments long, n_tokens long, edited_chars long, edited_tokens long, reencoded_chars long, edited_sha256 string, segment_chars array<int>, segment_tokens array<int>",
    )


def revisions(text: Column, n: Column) -> Column:
    """Three edits that only the row decides: a line put in at a third, as many as twenty code points out at two thirds, and the beginning rewritten."""
    step = lambda a, b, c: F.struct(a.cast("long").alias("start"), b.cast("long").alias("removed"), c.alias("inserted"))
    return F.array(
        step(F.floor(n / 3), F.lit(0), F.concat(F.lit("\nRevised: "), F.substring(text, 1, 12), F.lit(" 2024."))),
        step(F.floor(2 * n / 3), F.lit(20), F.lit("")),
        step(F.lit(0), F.lit(5), F.lit("It's  ")),
    )
