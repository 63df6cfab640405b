"""The operators against brute force, and their defined cases."""

import hashlib
import io
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, fingerprints, graph, mixing, near_dedup, packing, queries, sharding, substring_dedup, token_counts, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, `key` int, shard int"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"w{i}." for i in range(30_000))
    rows = [
        (1, "One two three four. Five six!", "en", "a", 29, "d", 1, 1), (1, "One two three four. Five six!", "en", "a", 29, "d", 1, 1),
        (2, None, None, None, None, None, None, None), (3, "", "en", "a", 0, "d", 1, 1), (4, " \t\n ", "en", "b", 4, "d", 1, 1),
        (None, "no id at all", "en", None, 12, "d", 1, 1), (5, long_text, "en", "b", len(long_text), "d", 1, 1), (6, long_text + " more", "en", "b", 1, "d", 1, 1),
        (7, "word", "fr", "c", 4, "d", 1, 1), (8, "WORD", "fr", "c", 4, "d", 1, 1), (9, "One two\tthree four. Five  six!", "en", "a", 30, "d", 1, 1), (10, "é ß 漢字 <|endoftext|> x", "de", "c", 9, "d", 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(texts, k):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


# 1


def test_exact_dedup_equals_brute_force(docs, texts):
    rows = {r["doc_id"]: r for r in exact_dedup.decisions(docs).collect()}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t)].append((-len(t), i))
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            r = rows[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    kept = {r["doc_id"] for r in exact_dedup.dedup(docs).collect()}
    assert kept == {min(m)[1] for m in groups.values()}


def test_exact_dedup_finds_across_and_inside_snapshots(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "ab c"), (4, "abc"), (6, "x"), (8, "x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["known"]) for r in exact_dedup.decisions(rows).collect()}
    assert got == {1: (2, 2, True), 2: (2, 2, True), 3: (3, 2, True), 4: (3, 2, True), 6: (6, 2, True), 8: (6, 2, True)}
    got = {r["doc_id"]: r["known"] for r in exact_dedup.decisions(rows, F.lit(False)).collect()}
    assert not any(got.values()) and len(got) == 6


def test_a_first_batch_is_dealt_to_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_BUCKET", 500)
    asked = []
    screened = exact_dedup.screened
    monkeypatch.setattr(exact_dedup, "screened", lambda new, filt, buckets: asked.append(buckets) or screened(new, filt, buckets))
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 4000).cast("string")).alias("text"))
    out = exact_dedup.decisions(docs, F.lit(False))
    assert out.where("kept").count() == 4000 and out.where("known").count() == 0 and asked == [8]


def test_texts_of_one_digest_are_told_apart_by_their_bytes(spark):
    docs = spark.createDataFrame([(2, "ab c"), (3, "xyz"), (4, "abc"), (5, "x yz"), (7, "long er")], "doc_id long, text string")
    weak = lambda norm: F.sha2(F.length(norm).cast("string"), 256)
    got = {r["doc_id"]: r for r in exact_dedup.decisions(docs, hex_digest=weak).collect()}
    assert [(i, got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) for i in sorted(got)] == [(2, 2, 2, True), (3, 5, 2, False), (4, 2, 2, False), (5, 5, 2, True), (7, 7, 1, True)]


def test_fuse_filters_hold_every_key():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 1000, 20_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        made = exact_dedup.build_filter(keys)
        assert exact_dedup.maybe_in(made, keys).all()
        assert exact_dedup.maybe_in(made, rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.001


def test_exact_dedup_defined_cases(odd, none):
    rows = exact_dedup.decisions(odd).collect()
    assert len(rows) == odd.count() and sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] in (2, 3, 4)} == {(4, 3)}
    assert exact_dedup.dedup(odd).columns == odd.columns
    assert exact_dedup.decisions(none).count() == 0 and exact_dedup.dedup(none).count() == 0


# 2


def test_fingerprints_equal_brute_force(docs, texts):
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in fingerprints.compared(docs).collect()}
    assert len(rows) == len(texts)
    better = 0
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[i], len(texts[i])
        edited = t[: n - n // 2] + texts[j][: n // 2]
        r = rows[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        mine, new, other = (fingerprints.fingerprint(x) for x in (t, edited, texts[j]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (mine.tobytes().hex(), new.tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(mine, new), fingerprints.likeness(mine, other))
        better += r["near_edited"] > r["near_next"]
    assert better > 0.9 * len(texts)


def test_fingerprint_estimates_the_common_phrases(texts):
    found = []
    items = [t for t in texts.values() if len(t) > 1500][:40]
    for a, b in zip(items, items[1:], strict=False):
        b = a[: len(a) // 2] + b
        x, y = {}, {}
        fingerprints.parse(x, "", a)
        fingerprints.parse(y, "", b)
        found.append(abs(len(x.keys() & y.keys()) / len(x.keys() | y.keys()) - fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b))))
    assert np.mean(found) < 0.06


def test_fingerprints_defined_cases(odd, none, spark):
    rows = fingerprints.compared(odd, ranges=5).collect()
    assert len(rows) == odd.count()
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3)} == {""}
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 1
    assert fingerprints.compared(none).count() == 0
    one = fingerprints.compared(spark.createDataFrame([(4, "lonely text")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0


# 3


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    bad = ["loathsomer", "vileness", "scornful"]
    texts, y = [], []
    for i in range(600):
        w = list(rng.choice(plain, rng.integers(20, 200)))
        if i % 3 == 0:
            for _ in range(max(2, len(w) // 20)):
                w[rng.integers(len(w))] = str(rng.choice(bad)) + str(rng.choice(["", "s", "ing"]))
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    m = toxicity.train(texts[:400], y[:400], steps=120)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.scores(rows, m).collect()}
    assert np.mean([got[i]["predicted"] == y[i] for i in range(400, 600)]) > 0.95
    for i in (5, 77):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    kept = {r["doc_id"] for r in toxicity.clean(rows, m).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_windows_cover_whole_texts():
    for n in (0, 1, 47, 48, 49, 84, 85, 500):
        data = " ".join(f"x{i}" for i in range(n)).encode()
        c = toxicity.Corpus(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        covered = {p for a, k in zip(c.at, c.length, strict=True) for p in range(a, a + k)}
        assert covered == set(range(n))


def test_toxicity_gradient_is_right():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["aa", "bbb", "cccc", "dd", "e"], 30)) for _ in range(6)]
    data = [t.encode() for t in texts]
    c = toxicity.Corpus(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    m = {k: v if k == "vocabulary" else v.astype(np.float64) for k, v in toxicity.new_model(np.sort(c.hashes)).items()}
    index, mask = c.rows(np.arange(len(c.text)))
    label = np.array([1.0, 0, 1, 0, 1, 0])

    def loss(model):
        x, _ = toxicity.word_inputs(model, c)
        z, _ = toxicity.forward(model, x.astype(np.float64), index, mask)
        return float(np.sum(np.logaddexp(0, z) - label * z))

    x, at = toxicity.word_inputs(m, c)
    z, saved = toxicity.forward(m, x, index, mask, keep=True)
    g = toxicity.gradients(m, c, x, at, index, mask, 1 / (1 + np.exp(-z)) - label, saved, np.ones_like(x))
    for name in ("Wf", "Ub", "att", "out", "cf", "bias", "word", "char"):
        flat = np.abs(g[name]).ravel()
        i = np.unravel_index(int(np.argmax(flat)), g[name].shape)
        up, down = ({k: v.copy() for k, v in m.items()} for _ in range(2))
        up[name][i] += 2e-2
        down[name][i] -= 2e-2
        assert abs((loss(up) - loss(down)) / 4e-2 - g[name][i]) < 0.05 * abs(g[name][i]) + 2e-3, name


def test_toxicity_sample_is_of_the_docs_and_has_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 4)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 4)
    taught = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: taught.append((texts, toxic)) or {"constant": np.zeros(1)})
    order = sorted((i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(order)], "doc_id long, toxic int")
    words = " ".join(f"w{k}" for k in range(20_000))
    last = order[-8:]  # the docs hold only the last labelled ids in the sample's order, all of them long
    docs = spark.createDataFrame([(i, f"start{i} {words} end{i}") for i in last], "doc_id long, text string")
    toxicity.fit(docs, labels)
    texts, toxic = taught.pop()
    assert sorted(toxic) == [0] * 4 + [1] * 4 and set(texts) == {f"start{i} {words} end{i}" for i in last}
    # the bounds leave out rows, never parts of texts
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 2 * (len(words) + 20))
    toxicity.fit(docs, labels)
    texts, toxic = taught.pop()
    assert sorted(toxic) == [0] * 2 + [1] * 2 and set(texts) == {f"start{i} {words} end{i}" for i in last[:4]}
    monkeypatch.setattr(toxicity, "LONGEST", len(words))
    with pytest.warns(RuntimeWarning, match="0 toxic"):
        toxicity.fit(docs, labels)
    assert taught.pop() == ([], [])
    monkeypatch.setattr(toxicity, "LONGEST", len(words) + 40)
    with pytest.warns(RuntimeWarning, match="0 toxic"):
        toxicity.fit(docs, labels.where("toxic = 0"))


def test_toxicity_evidence_stands_above_chance():
    texts = [f"own{i} common word {'rude' if i < 12 else 'nice'}" for i in range(100)]
    data = [t.encode() for t in texts]
    c = toxicity.Corpus(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    e = toxicity.evidence(c, np.arange(100) < 12, np.ones(100, bool))
    assert (e > 0).sum() == 1 and (e < 0).sum() == 1 and (e == 0).sum() == len(c.hashes) - 2
    # what is written once a text counts once: no words of a text that is not used count
    assert not toxicity.evidence(c, np.arange(100) < 12, np.arange(100) % 12 == 0).any()


def test_toxicity_training_holds_little_beside_its_words():
    """Evidence counts the words of some texts at a time, and grams take two bytes: the driver trains beside all else that it holds."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 20_000, 500)) for _ in range(1000)]
    data = [t.encode() for t in texts]
    c = toxicity.Corpus(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    y, use = np.arange(1000) % 9 == 0, np.arange(1000) % 5 > 0
    sets = [set(c.index[a:b].tolist()) for a, b in zip(c.first, c.first[1:], strict=False)]
    tracemalloc.start()
    e = toxicity.evidence(c, y, use)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000 and c.grams.itemsize == 2
    n, hits = (np.bincount([w for i in np.flatnonzero(k) for w in sets[i]], minlength=len(c.hashes)) for k in (use, use & y))
    share, usual = hits / np.maximum(n, 1), y[use].mean()
    gain = n * sum(p * np.log(np.where(p > 0, p, 1) / q) for p, q in ((share, usual), (1 - share, 1 - usual)))
    assert np.allclose(e, np.sign(share - usual) * np.maximum(gain - np.log((n >= 3).sum()), 0) * (n >= 3))


def test_toxicity_learns_from_few_labels():
    """Thirty toxic texts hold one of five words in much other prose of their own; held-out ones are found and clean ones stay."""
    rng = np.random.default_rng(8)
    prose = lambda: " ".join("".join(rng.choice(list("abcdehinorst"), 6)) for _ in range(120))
    y = np.arange(300) % 10 == 0
    texts = [f"{prose()} {rng.choice(['vile', 'scummy', 'wretch', 'brute', 'oaf'])} {prose()}" if k else f"{prose()} {prose()}" for k in y]
    m = toxicity.train(texts[:200], y[:200].tolist(), steps=60)
    data = [t.encode() for t in texts[200:]]
    c = toxicity.Corpus(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    found = 1 / (1 + np.exp(-toxicity.text_logits(m, c, 100))) >= toxicity.THRESHOLD
    assert found[y[200:]].mean() >= 0.8 and found[~y[200:]].mean() <= 0.05


def test_toxicity_defined_cases(odd, none, spark):
    labels = spark.createDataFrame([(1, 0), (3, None), (None, 1), (7, 1), (7, 0)], "doc_id long, toxic int")
    m = toxicity.fit(odd, labels)
    rows = toxicity.scores(odd, m).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0.0}
    m = toxicity.fit(none, labels)
    assert toxicity.scores(none, m).count() == 0 and toxicity.clean(odd, m).columns == odd.columns


# 4


def test_mixing_meets_targets(docs, texts):
    rows = mixing.mix(docs).collect()
    sizes = {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    total = sum(sizes.values())
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1:] = [r["target"], r["source_size"]]
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * total) < 1e-6 * total
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}
    open_sources = [s for s in by if by[s][1] < 2 * by[s][2] - 1e-6]
    assert len({round(by[s][1] / weights[s], 4) for s in open_sources}) <= 1
    for taken, target, _ in by.values():
        assert abs(taken - target) < 1
    at = [r["position"] for r in rows if r["position"] is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    out = mixing.mixed(docs).collect()
    assert sum(len(WORD.findall(r["text"])) for r in out) == sum(t for t, _, _ in by.values())


def test_schedules_deliver_over_time(docs):
    """Up to any time, a source's documents amount to its integrated schedule."""
    rows = [r for r in mixing.mix(docs).collect()]
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        target, slope = mine[0]["target"], [-0.5, 0.0, 0.5][sorted({r["source"] for r in rows}).index(s) % 3]
        largest = max(r["size"] for r in mine)
        for t in (0.25, 0.5, 0.75):
            due = sum(r["first"] for r in mine if r["position"] is not None and r["position"] <= t) + sum(r["taken"] - r["first"] for r in mine if r["second_position"] is not None and r["second_position"] <= t)
            assert abs(due - target * (t + slope * (t * t - t))) <= largest + 1


def test_mixing_defined_cases(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_repeated_rows_are_mixed_as_planned(spark):
    rows = [(1, "one two three", "a", "x")] * 3 + [(1, "one two three", "a", "y"), (1, "other words", "b", "x"), (2, "four five six seven", "a", None), (None, "no id", "c", "x"), (None, "no id", "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row_hash string")
    plan = mixing.mix(docs).collect()
    out = mixing.mixed(docs).collect()
    assert sum(len(WORD.findall(r["text"])) for r in out) == sum(r["taken"] for r in plan)
    assert len(out) == sum((r["position"] is not None) + (r["second_position"] is not None) for r in plan)
    assert Counter(r["row_hash"] for r in out if r["doc_id"] == 1 and r["source"] == "a")["x"] <= 6


# 5


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_equals_brute_force(docs, texts, k):
    sets = shingle_sets(texts, k)
    want = brute_components(sets, 80)
    rows = {r["doc_id"]: r for r in near_dedup.classes(docs, k).collect()}
    assert {i: len(s) for i, s in sets.items()} == {i: r["n_shingles"] for i, r in rows.items()}
    assert want == {i: r["component_id"] for i, r in rows.items()}
    assert {r["doc_id"] for r in near_dedup.dedup(docs, k).collect()} == {i for i, c in want.items() if i == c}


def test_near_dedup_links_round_a_smallest_one(spark):
    """A chain whose ends do not resemble each other is one component; equal sets count once."""
    base = [f"t{i}" for i in range(200)]
    rows = [(n + 1, " ".join(base[n * 8 : n * 8 + 100])) for n in range(12)]
    rows += [(100 + n, rows[n % 3][1].upper()) for n in range(30)]
    sets = shingle_sets(dict(rows), 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute_components(sets, 80)
    assert len(set(got.values())) == 1


def test_registers_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.8):
        errors = []
        for _ in range(30):
            n = int(rng.integers(50, 3000))
            both = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
            cut = int(n * 2 * share / (1 + share))
            a, b = both, np.concatenate([both[:cut], rng.integers(0, 2**63, n - cut).astype(np.uint64) * np.uint64(2) + np.uint64(1)])
            equal = (near_dedup.registers(near_dedup.mix(a)) == near_dedup.registers(near_dedup.mix(b))).mean()
            c = near_dedup.chance(np.array([float(n)]), np.array([float(n)]))[0]
            errors.append((equal - c) / (1 - c) - cut / (2 * n - cut))
        assert abs(np.mean(errors)) < 0.02


def test_near_dedup_defined_cases(odd, none):
    rows = near_dedup.classes(odd, 2).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert (by[8]["component_id"], by[6]["component_id"], by[9]["component_id"]) == (7, 5, 1)
    assert all(by[i]["kept"] and by[i]["n_shingles"] == 0 for i in (2, 3, 4))
    assert near_dedup.dedup(odd, 2).columns == odd.columns
    assert near_dedup.classes(none).count() == 0 and near_dedup.dedup(none).count() == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}


def test_further_links_merge_components(spark):
    """Links between two components, from a component to an id without links, and between two such ids."""
    first = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], "a long, b long")
    more = spark.createDataFrame([(3, 11), (5, 20), (30, 31)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.merged(graph.components(first), more).collect()}
    assert got == {r["id"]: r["component"] for r in graph.components(first.unionByName(more)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 5: 5, 20: 5, 21: 5, 30: 30, 31: 30}


def test_near_dedup_keeps_other_texts_of_a_repeated_id(spark):
    rows = [(4, "a b c d e f"), (4, "g h i j k l"), (4, "a b c d e f"), (9, "A b c d e  f"), (None, "m n o p q r")]
    got = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "m n o p q r"), (4, "a b c d e f"), (4, "g h i j k l")]


# 6


def test_packing_equals_brute_force(docs, texts):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokens = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    check_pack(packing.pack(docs).collect(), tokens)


def check_pack(rows, tokens, within=1.04):
    by, at = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == set(tokens)
    for i, own in by.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        begin = 0
        for r in own:
            assert r["start"] == begin and (r["piece"] == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(tokens[i][begin : begin + r["length"]].tobytes())
            begin += r["length"]
        assert begin == len(tokens[i])
    for spans in at.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(at) <= within * -(-sum(map(len, tokens.values())) // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(5.5, 1.3, 4000).astype(int) + 1, 2048)
    histogram = dict(Counter(lengths.tolist()))
    runs = packing.plan(histogram)
    placed, seen = [], Counter()
    for r in runs.itertuples():
        n = r.rank_to - r.rank_from
        placed += [(r.sequence + k, r.offset, r.length) for k in range(n)]
        seen[r.length] += n
    placed.sort()
    end = (None, 0)
    for sequence, offset, length in placed:  # each piece begins where the one before it ends
        assert offset == (end[1] if end[0] == sequence else 0)
        end = (sequence, offset + length)
        assert end[1] <= 2048
    assert seen == Counter(histogram)
    assert len({s for s, _, _ in placed}) <= 1.01 * -(-lengths.sum() // 2048) + 1


def test_packing_defined_cases(odd, none):
    rows = packing.pack(odd).collect()
    assert {r["length"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0)[1] == 2
    assert packing.pack(none).count() == 0


# 7


def test_sharding_law_and_cut(docs, texts):
    rows = sharding.shard(docs).collect()
    check_shards(rows, texts)
    where = {r["doc_id"]: r["shard"] for r in rows}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    groups = [g for g in groups.values() if len(g) > 1]
    assert sum(len({where[i] for i in g}) == 1 for g in groups) >= 0.9 * len(groups)


def check_shards(rows, texts):
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_a_third_of_all_rows_in_one_group(spark):
    texts = {i: "same" if i % 3 == 0 else f"text {i // 2}" for i in range(600)}
    rows = sharding.shard(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    check_shards(rows, texts)
    hot = Counter(r["shard"] for r in rows if texts[r["doc_id"]] == "same")
    assert len(hot) <= 8  # 200 rows need six shards of 37 or 38
    pairs = defaultdict(set)
    for r in rows:
        if texts[r["doc_id"]] != "same":
            pairs[texts[r["doc_id"]]].add(r["shard"])
    assert np.mean([len(s) == 1 for s in pairs.values()]) > 0.8


def test_sharding_defined_cases(odd, none):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count() and sharding.shard(none).count() == 0
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) == 1


# 8


def test_warc_round_trip_equals_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    top = {}
    for i, h in html.items():
        top[h] = max(i, top.get(h, i))
    for r in warc.round_trip(pages).collect():
        h = html[r["page_id"]]
        again = len(h) >= 1000 and top[h] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", top[h] if again else None)


def test_warc_reader_in_small_blocks_and_broken_archives():
    payloads = [b"", b"x" * 5000, bytes(range(256)) * 40, b"\r\n\r\nWARC/1.1\r\n"]
    data = b"".join(warc.record(i, "http://a/\r\nb", p, len(p), hashlib.sha1(p).hexdigest(), None, False) for i, p in enumerate(payloads))
    for block in (1, 7, 1000, 1 << 18):
        got = list(warc.records(io.BytesIO(data), block))
        assert got == [(i, len(p), hashlib.sha1(p).hexdigest(), "response", None) for i, p in enumerate(payloads)]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-9])))
    wrong = warc.record(1, None, b"abc", 3, hashlib.sha1(b"abd").hexdigest(), None, False)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(wrong)))


def test_warc_defined_cases(spark):
    same = "y" * 1200
    pages = spark.createDataFrame([(1, None, None), (None, "u", same), (3, "u", same), (3, "u", same), (4, "v", same), (5, "w", "")], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect()), key=str)
    want = [(1, "response", None, 0), (3, "revisit", 4, 1200), (3, "revisit", 4, 1200), (4, "response", None, 1200), (5, "response", None, 0), (None, "revisit", 4, 1200)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("page_id > 99")).count() == 0


# 9


def units(text):
    out = []
    for line in text.split("\n"):
        cur = []
        for w in WORD.findall(line):
            cur.append(w)
            if re.search("[.!?]", w):
                out.append(cur)
                cur = []
        if cur:
            out.append(cur)
    return out


def brute_removed(texts):
    first, spans = {}, defaultdict(list)
    for i in sorted(texts):
        u = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in x] for x in units(texts[i])]
        for a in range(len(u)):
            b = a + 3
            while b < len(u) and sum(map(len, u[a:b])) < 24:
                b += 1
            if b <= len(u) and sum(map(len, u[a:b])) >= 24:
                key = tuple(w for x in u[a:b] for w in x)
                if first.setdefault(key, (i, a)) != (i, a):
                    spans[i] += range(a, b)
    return {i: len(set(s)) for i, s in spans.items()}


def test_substring_dedup_equals_brute_force(docs, texts):
    want = brute_removed(texts)
    rows = {r["doc_id"]: r for r in substring_dedup.changed(docs).collect()}
    assert {i: r["removed_sentences"] for i, r in rows.items()} == want
    for i, r in rows.items():
        assert r["n_sentences"] == len(units(texts[i])) and len(r["text"]) == len(texts[i]) - r["removed_chars"]
        assert len(WORD.findall(r["text"])) == len(WORD.findall(texts[i])) - r["removed_words"]
    clean = {r["doc_id"]: r["text"] for r in substring_dedup.cleaned(docs).collect()}
    assert all(clean[i] == (rows[i]["text"] if i in rows else t) for i, t in texts.items())


def test_planted_passages_go_and_the_rest_stays(spark):
    passage = "Alpha beta gamma delta. " + " ".join(f"p{i}" for i in range(40)) + ". End of the passage here now. And one more for luck."
    rows = [(i, " ".join(f"d{i}w{k}{'.' if k % 7 == 0 else ''}" for k in range(80)) + ".\n" + (passage if i in (3, 5, 9) else "Own words.") + f"\nTail of {i}.") for i in range(12)]
    got = {r["doc_id"]: r for r in substring_dedup.changed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {5, 9} and got[5]["first_doc_ids"] == [3] == got[9]["first_doc_ids"]
    assert "p20" not in got[5]["text"] and "d5w79" in got[5]["text"] and "Tail of 5." in got[5]["text"]


def test_passages_at_random_words_of_sentences_go(spark):
    rng = np.random.default_rng(4)
    pool = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(3000)]

    def prose(n, closing):
        return [str(w) + ("." if closing and rng.random() < 0.06 else "") for w in rng.choice(pool, n)]

    rows, passages = [], {}
    for k in range(60):
        passage = [f"{w[:-1]}q{k}." if w.endswith(".") else f"{w}q{k}" for w in prose(int(rng.integers(51, 71)), k % 2)]
        for copy in (0, 1):
            host = prose(200, k % 3)
            at = int(rng.integers(0, 201))
            rows.append((2 * k + copy, " ".join(host[:at] + passage + host[at:])))
        passages[2 * k + 1] = (set(passage), set(host))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in substring_dedup.changed(docs, inside=True).collect()}
    assert set(got) == set(passages) and all(r["first_doc_ids"] == [i - 1] for i, r in got.items())
    share = []
    for i, (passage, host) in passages.items():
        left = set(got[i]["text"].split(" "))
        assert host <= left
        share.append(1 - len(passage & left) / len(passage))
    assert min(share) > 0.6 and np.mean(share) > 0.88
    clean = {r["doc_id"]: r["text"] for r in substring_dedup.cleaned(docs, inside=True).collect()}
    assert all(clean[i] == (got[i]["text"] if i in got else t) for i, t in rows)


def test_the_query_cuts_by_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {(r["doc_id"], r["removed_words"]) for r in substring_dedup.changed(docs, inside=True).collect()}
    assert {(r["doc_id"], r["removed_words"]) for r in queries.op9_substring_dedup(spark, sf).collect()} == want


def test_rows_without_an_id_are_told_apart(spark):
    """Many rows with a null doc_id, some of one 32-bit hash: each loses its own spans."""
    passage = " ".join(f"w{i % 7} word{i} z{i}{'.' if i % 9 == 8 else ''}" for i in range(40)) + "."
    rows = [(None, f"Row {i} begins. {passage} Row {i} ends." if i % 2 else f"Only {i} stands here and says nothing new at all.") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r["text"] for r in substring_dedup.cleaned(df, inside=True).collect()]
    assert sum("word20" in t for t in left) == 1 and all(f"Only {i} stands" in " ".join(left) for i in range(0, 400, 2))


def test_substring_dedup_defined_cases(odd, none):
    got = {r["doc_id"]: r for r in substring_dedup.changed(odd).collect()}
    assert set(got) == {6} and got[6]["first_doc_ids"] == [5]
    out = substring_dedup.cleaned(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert substring_dedup.changed(none).count() == 0 and substring_dedup.cleaned(none).count() == 0


# 10


def test_token_counts_equal_full_encoding(docs, texts):
    encode = packing.encoder()
    rows = queries.token_counts.counted(docs, token_counts.revisions(queries.text_or_empty(), F.length(queries.text_or_empty()))).collect()
    for r in rows:
        t = texts[r["doc_id"]]
        n = len(t)
        assert r["n_tokens"] == len(encode(t))
        for start, removed, inserted in ((n // 3, 0, f"\nRevised: {t[:12]} 2024."), (2 * n // 3, 20, ""), (0, 5, "It's  ")):
            t = t[:start] + inserted + t[start + removed :]
        assert r["edited_tokens"] == len(encode(t)) == sum(r["segment_tokens"]) and r["edited_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert r["reencoded_chars"] <= 12 * token_counts.SEGMENT + 200 or r["reencoded_chars"] < n


def test_random_edits_keep_the_tree_right():
    encode = packing.encoder()
    rng = np.random.default_rng(2)
    pool = list("abc dé's  \n\t.,!12") + [" ", "  ", " ", " "]
    for _ in range(60):
        text = "".join(rng.choice(pool, rng.integers(0, 9000)))
        tree = token_counts.tree_of(text, encode)
        for _ in range(12):
            start, removed = int(rng.integers(0, len(text) + 2)), int(rng.choice([0, 1, 5, 3000]))
            inserted = "".join(rng.choice(pool, rng.choice([0, 1, 4, 2500])))
            want = text[:start] + inserted + text[min(start, len(text)) + removed :]
            text, _ = token_counts.edit(text, tree, start, removed, inserted, encode)
            assert text == want and tree.tokens == len(encode(text)) and tree.chars == len(text)


def test_texts_without_white_space_are_cut_where_kinds_of_characters_meet():
    """100,000 CJK characters with stops and numbers: an edit encodes a few thousand, and counts stay those of the whole."""
    encode = packing.encoder()
    rng = np.random.default_rng(8)
    pool = list("漢字仮名交文日本語") * 6 + list("。、！12Aaé'")
    text = "".join(rng.choice(pool, 100_000))
    tree = token_counts.tree_of(text, encode)
    assert tree.tokens == len(encode(text)) and len(tree.rows[0]) > 80
    for _ in range(25):
        start, inserted = int(rng.integers(0, len(text))), "".join(rng.choice(pool, int(rng.choice([0, 1, 30]))))
        text, k = token_counts.edit(text, tree, start, int(rng.choice([0, 1, 7])), inserted, encode)
        assert k < 5000 and tree.tokens == len(encode(text)) and tree.chars == len(text)
    pool += ["'s", "'ll", " ", "\n", "\u3000", "!'"]
    for _ in range(40):
        text = "".join(rng.choice(pool, 3000))
        assert token_counts.tree_of(text, encode).tokens == len(encode(text))


def test_kept_trees_are_used_again(docs):
    first = token_counts.counted(docs)
    again = docs.join(first.select("doc_id", "segment_chars", "segment_tokens"), "doc_id")
    got = token_counts.counted(again, F.array(F.struct(F.lit(10).alias("start"), F.lit(3).alias("removed"), F.lit("new words").alias("inserted"))))
    full = token_counts.counted(docs.withColumn("text", F.concat(F.substring("text", 1, 10), F.lit("new words"), F.expr("substring(text, 14)"))))
    assert {(r["doc_id"], r["edited_tokens"]) for r in got.collect()} == {(r["doc_id"], r["n_tokens"]) for r in full.collect()}


def test_token_counts_defined_cases(odd, none):
    rows = token_counts.counted(odd).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert token_counts.counted(none).count() == 0


# pipeline


def test_pipeline_stages_and_run(spark, sf, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(p.STAGES):
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(p.STAGES) - 1:
            assert docs.columns == names
        if k == 1:
            assert docs.count() == exact_dedup.decisions(before).where("kept").count()
        if k == 2:
            sets = shingle_sets({r["doc_id"]: r["text"] for r in before.collect()}, 5)
            assert {r["doc_id"] for r in docs.collect()} == {i for i, c in brute_components(sets, 80).items() if i == c}
        if k == 4:
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert p.run(spark, sf).count() == docs.count()


# independent checks


def lz_phrases(text):
    """The phrases of a text by the definition: each the longest phrase met before plus one character."""
    met, i = set(), 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in met:
            n += 1
        if i + n > len(text):
            break
        met.add(text[i : i + n])
        i += n
    return met


def test_phrases_by_their_definition(texts):
    for text in [*list(texts.values())[:60], "", "a", "aaaaaaa", "abababab é漢é漢", "x" * 500]:
        seen: dict = {}
        fingerprints.parse(seen, "", text)
        assert set(seen) == lz_phrases(text)


def test_fit_never_sees_held_out_labels(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: taught.append(list(zip(texts, toxic, strict=True))) or {"constant": np.zeros(1)})
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(400)], "doc_id long, text string")
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, 0, int((i % 3 == 0) ^ bool(flip and i in held))) for i in range(400)], "doc_id long, quality int, toxic int")
        toxicity.fit(docs, labels)
    assert sorted(taught[0]) == sorted(taught[1]) and not {t for t, _ in taught[0]} & {f"text number {i}" for i in held}
    assert len(taught[0]) == 400 - len(held)


def test_columns_with_the_names_used_inside(spark):
    names = ["key", "copy", "row_hash", "place", "spans", "found_id", "full_size", "first_ids", "n_sentences"]
    rows = [(i, f"Some text of number {i % 3} and more of it here. " * 5, "ab"[i % 2], *([i] * len(names))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for stage in (exact_dedup.dedup, near_dedup.dedup, mixing.mixed, substring_dedup.cleaned):
        out = stage(docs)
        assert out.columns == docs.columns and all(r[n] == r["doc_id"] for r in out.collect() for n in names)


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and (docs is odd or out.count() == 0), name
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
