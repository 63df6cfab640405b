"""Prefix tries, line dedup and fill-in-the-middle against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_middle, line_dedup, prefix_trie, queries

BLANKS = " \t\n\x0b\x0c\r"
TALK = "conv_id long, turn long, role string, text string, conv long, `block` int, total string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def brute_trie(rows):
    """rows of (conv_id, turn, role, text) without ties: the nodes as the query's rows."""
    turns = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns[conv].append((role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(turns):
        h = zlib.crc32(str(conv).encode()) % 6
        way = tuple(turns.get(int(conv / 100) * 100, [])[:h] + turns[conv][h:])  # towards 0, as in SQL
        for d in range(len(way) + 1):
            members[way[:d]].append(conv)
        ends[way].append(conv)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        saved[node] = sum(saved[x] for x in below[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below[n]), leaves[n], saved[n], sha(",".join(map(str, ends[n])))) for n, m in members.items())


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def test_trie_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_prefix_trie(spark, sf)) == brute_trie(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_long_and_shared_conversations(spark, monkeypatch, seed):
    """Blocks, shards and chunks smaller than the conversations; copies, prefixes of one another, turnless ones, missing bases."""
    for name, value in (("BLOCK", 4), ("CHUNK", 3)):
        monkeypatch.setattr(prefix_trie, name, value)
    draw = random.Random(seed)
    rows, last = [], []
    for conv in [*range(0, 30), *range(95, 130), 250, 251, 399, -7]:
        if last and draw.random() < 0.6:
            way = last[: draw.randint(1, len(last))] + [draw.choice(["a", "b", "é字"]) for _ in range(draw.choice([0, 0, 1, 6]))]
        else:
            way = [draw.choice(["a", "b", "c" * 9]) for _ in range(draw.choice([1, 2, 3, 9, 14]))]
        last = way
        rows += [(conv, None if t == 0 and conv % 3 == 0 else 2 * t, "user" if t % 2 else None, x, 1, 2, "x") for t, x in enumerate(way)]
    draw.shuffle(rows)
    talk = spark.createDataFrame(rows, TALK)
    assert found(prefix_trie.trie(talk, size=5)) == brute_trie([r[:4] for r in rows])


def test_trie_of_one_group_of_copies(spark):
    """A third of all conversations are equal; the list of their ends crosses shards."""
    rows = [(conv, t, "user", f"line {t}" if conv % 3 == 0 else f"{conv} {t}") for conv in range(1000, 1600) for t in range(3)]
    assert found(prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), size=16)) == brute_trie(rows)


def test_trie_defined_cases(spark):
    none = spark.createDataFrame([], TALK)
    assert prefix_trie.trie(none).count() == 0
    odd = [(None, 1, "user", "no conversation", 1, 1, "x"), (5, None, None, None, 1, 1, "x"), (5, 1, "user", "x" * 100_000, 1, 1, None), (7, 0, "", "", 1, 1, "x")]
    assert found(prefix_trie.trie(spark.createDataFrame(odd, TALK))) == brute_trie([r[:4] for r in odd])
    twice = spark.createDataFrame([(8, 1, "user", "again", 0, 0, "x")] * 3 + [(8, 1, "user", "tie", 0, 0, "x")], TALK)
    once = found(prefix_trie.trie(twice))
    assert once == found(prefix_trie.trie(twice.repartition(3))) and once[0][3] == 1


# 12


def brute_lines(rows, least=10, keep_first=False):
    """rows of (doc_id, text): (doc_id, n_lines, n_dropped, kept_sha256) of each."""
    key = lambda line: line.strip(BLANKS).translate({c: c + 32 for c in range(65, 91)})
    holders, firsts = defaultdict(set), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for pos, line in enumerate((text or "").split("\n")):
            holders[key(line)].add((doc, text))
            firsts.setdefault(key(line), (doc, text, pos))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if not key(x) or len(holders[key(x)]) < least or keep_first and firsts[key(x)] == (doc, text, pos)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def lines_of(docs, **rule):
    out = line_dedup.decided(docs, **rule)
    return sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2(line_dedup.kept_text(F.col("text"), F.col("keep_runs")), 256)).collect()), key=str)


def test_lines_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = lines_of(docs)
    assert got == brute_lines(rows) and sum(r[2] for r in got)
    assert lines_of(docs, least_docs=2, keep_first=True) == brute_lines(rows, 2, True)


def test_lines_defined_cases(spark):
    schema = "doc_id long, text string, h string, id int, part int, pos int, gone string"
    body = [f"Common LINE\n own {i}\n\n\tcommon line \x0b\nÉ Ä" for i in range(12)]
    rows = [(i, t, "x", 1, 1, 1, None) for i, t in enumerate(body)] + [(None, "common line", "x", 1, 1, 1, "x"), (20, None, None, None, None, None, None), (21, "", "x", 1, 1, 1, "x"), (22, "\n\n", "x", 1, 1, 1, "x"), (23, "common line\n", "x", 1, 1, 1, "x"), (24, "é ä", "x", 1, 1, 1, "x")]
    rows += [rows[0]] * 3 + [(25, "twice as one", "x", 1, 1, 1, "x")] * 11 + [(None, f"{i}\ntwice with one name", "x", 1, 1, 1, "x") for i in range(10)]
    rows += [(30, "long\n" * 50_000 + "common line", "x", 1, 1, 1, "x")]
    got = lines_of(spark.createDataFrame(rows, schema))
    assert got == brute_lines([r[:2] for r in rows])
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[20][1:] == (1, 0, sha("")) and by[23][2] == 1 and by[25][2] == 0 and by[24][2] == 0 and by[30][1] == 50_001
    assert line_dedup.bitmaps(spark.createDataFrame([], schema)).count() == 0


def test_keep_runs_are_the_lines_that_stay(spark):
    cases = [([], 3), ([0], 1), ([0, 1, 2], 3), ([1], 3), ([0, 2, 3, 7], 9), ([4], 5)]
    df = spark.createDataFrame(cases, "gone array<int>, n int")
    for r in df.withColumn("runs", line_dedup.keep_runs(F.col("gone"), F.col("n"))).collect():
        assert [p for x in r["runs"] for p in range(x["first"], x["first"] + x["length"])] == [p for p in range(r["n"]) if p not in r["gone"]]


# 13


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def middles(out):
    rows = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256))
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_middles_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((brute_middle(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert middles(fill_middle.transformed(docs)) == want and {r[2] for r in want} >= {"psm", "spm"}
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in queries.op13_fill_middle(spark, sf).collect()), key=str) == want


def test_middles_defined_cases(spark):
    schema = "doc_id long, text string, n int, form string, output string"
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "é字\n🙂\r\n x", "a <P> b\nc", "<\nS>\n<", "<S\n>P>\n<<M\n", "x\n" * 70_000 + "字" * 70_000 + "\n" * 140_000 + "end", "".join(random.Random(3).choice("ab\n") for _ in range(200_000))]
    rows = [(i, t, 1, "x", None) for t in texts for i in (None, 1, 2, 3, 4, 4, -5)]
    assert middles(fill_middle.transformed(spark.createDataFrame(rows, schema))) == sorted((brute_middle(*r[:2]) for r in rows), key=str)
    assert fill_middle.transformed(spark.createDataFrame([], schema)).count() == 0
    assert all(r["form"] == "plain" for r in fill_middle.transformed(spark.createDataFrame(rows, schema), rate=0).collect())


def test_containers_select_every_value():
    draw = np.random.default_rng(5)
    for share, kind in ((0.001, "Values"), (0.3, "Bits"), (1.0, "Runs")):
        low = np.flatnonzero(draw.random(fill_middle.SPAN) < share)
        held = fill_middle.container(low)
        assert type(held).__name__ == kind and [held.select(k) for k in range(len(low))] == low.tolist()
    text = np.frombuffer(("a\n" * 50_000 + "b" * 200_000 + "\n" * 70_000 + "c").encode(), np.uint8)
    ends = fill_middle.Boundaries(text)
    want = [0, *(np.flatnonzero(text == 10) + 1), len(text)]
    assert len(ends) == len(want) - 1 and all(ends.after(k) == want[k] for k in range(0, len(want), 997)) and ends.after(len(ends)) == len(text)
