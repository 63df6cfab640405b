"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own learned vector (the VOCABULARY words most frequent in the training sample) beside the mean of
learned vectors of its character 3-, 4- and 5-grams, so that unseen spellings and inflections still say something. Two
gated recurrent passes read a window of WINDOW words, attention pools their states and a linear layer gives a logit.
Windows overlap by a quarter and together cover the whole text; a document's logit is that of its worst window.

Training is on the driver, on whole texts of a sample of labelled documents, chosen by md5(doc_id) among those that docs hold.
Its bounds are rows: at most SAMPLE_TOXIC and SAMPLE_CLEAN, of at most LONGEST characters each, as long as their sum is
within SAMPLE_CHARS. Labels of documents with crc32(doc_id) mod 4 = 2 are never seen. A toxic document teaches through the
window that the model now finds worst, a clean one through that and random ones. A word's first input starts from the
evidence for it in the sample, and inputs stay as they start for the first WARM of the steps, so that a few dozen toxic texts
teach words and not their own surroundings. The model, a few hundred kilobytes whatever the corpus, then goes to the tasks, which score every window of every text.

Defined cases: null, empty and blank texts have no window and score 0; texts of fewer words than a window are one
window; rows that repeat a doc_id are scored one by one; without labels of both kinds every text with words scores the
share of toxic labels (0 where there are none); a null label is no label, and contradicting labels of one doc_id count
as toxic; empty tables give empty results; other columns are ignored by `scores` and carried by `clean`.
"""

from __future__ import annotations

import pickle
import warnings
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches
from .words import U, blocks, hashed_words, mix, separators

WINDOW, STRIDE = 48, 36
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
VOCABULARY, BUCKETS = 4096, 1 << 14
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2000
#: Longest text that trains, and characters of all texts of a kind that do: bounds on which rows are taken, each whole.
LONGEST, SAMPLE_CHARS = 200_000, 32_000_000
STEPS, BATCH, DROPOUT = 420, 256, 0.2
#: Largest start of a word's first input by its evidence.
EVIDENCE = 3.0
#: Share of the steps in which the inputs stay as they start.
WARM = 0.4
THRESHOLD = 0.3
#: Bytes of text that a task scores at once, and that training reads at once; words of texts that evidence counts at once.
BLOCK_BYTES, READ_BYTES, PAIRS = 1 << 19, 1 << 18, 1 << 17
_SEP = separators(b".,;:!?\"'()[]{}<>*#%$&+=/\\|~^_-")


def _runs(offsets: np.ndarray, most: int):
    """(from, to) of runs of texts with about `most` bytes (or of what offsets count); one longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of data that begin at starts, one after the other."""
    return data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


class Corpus:
    """Words of texts as indices of distinct words, and the windows over them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20):
        """Reads runs of texts of about `most` bytes one by one, so that only distinct words and one index a word are kept of all."""
        seen, letters, index, count = [], [], [], []
        for i, j in _runs(offsets, most):
            part = data[offsets[i] : offsets[j]]
            hashes, starts, ends, first = hashed_words(part, offsets[i : j + 1] - offsets[i], _SEP)
            distinct, at, place = np.unique(hashes, return_index=True, return_inverse=True)
            letters.append(_gathered(part, starts[at], (ends - starts)[at]))
            seen.append((distinct, (ends - starts)[at]))
            index.append(place.astype(np.int32))
            count.append(np.diff(first))
        every, size = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.hashes, pick = np.unique(every, return_index=True)
        self.index = np.concatenate([np.searchsorted(self.hashes, d).astype(np.int32)[i] for (d, _), i in zip(seen, index, strict=True)]) if seen else np.zeros(0, np.int32)
        every = np.concatenate(letters) if letters else np.zeros(0, np.uint8)
        self._spell(every, (np.cumsum(size) - size)[pick], size[pick])
        count = np.concatenate(count) if count else np.zeros(0, np.int64)
        self.first = first = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        # windows: (text, first word, words)
        windows = np.where(count == 0, 0, np.maximum(0, -(-(count - WINDOW) // STRIDE)) + 1)
        self.text = np.repeat(np.arange(len(count)), windows)
        within = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = first[:-1][self.text] + np.minimum(within * STRIDE, np.maximum(count[self.text] - WINDOW, 0))
        self.length = np.minimum(count[self.text], WINDOW)

    def _spell(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 15) -> None:
        """Hashes of the 3-, 4- and 5-grams of each distinct word between a mark of its start and one of its end, `most` words at a time."""
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        grams, counts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for i in range(0, len(sizes), most):
            n = sizes[i : i + most]
            begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(n + 2)])
            flat = np.zeros(int(begin[-1]), np.uint8)
            word = np.repeat(np.arange(len(n)), n)
            flat[np.arange(len(word)) + 2 * word + 1] = fold[_gathered(letters, starts[i : i + most], n)]
            flat[begin[:-1]], flat[begin[1:] - 1] = 1, 2
            owner = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
            found, owners = [], []
            values = flat.astype(np.uint32)
            for k in (3, 4, 5):
                m = len(flat) - k + 1
                if m <= 0:
                    continue
                h = np.full(m, k, np.uint32)
                for j in range(k):
                    h = h * np.uint32(0x01000193) ^ values[j : j + m]
                ok = owner[:m] == owner[k - 1 :]
                h = h[ok] * np.uint32(0x85EBCA6B)
                found.append(((h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35) >> np.uint32(18)).astype(np.uint16))
                owners.append(owner[:m][ok])
            own = np.concatenate(owners)
            grams.append(np.concatenate(found)[np.argsort(own, kind="stable")])
            counts.append(np.bincount(own, minlength=len(n)))
        self.grams = np.concatenate(grams)
        n = np.concatenate(counts)
        self.gram_first = np.cumsum(n) - n
        self.gram_count = np.maximum(n, 1).astype(np.float32)

    @cached_property
    def owner(self) -> np.ndarray:
        """The distinct word of each of `grams`; only gradients ask for it."""
        return np.repeat(np.arange(len(self.gram_first), dtype=np.int32), np.diff(np.append(self.gram_first, len(self.grams))))

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word indices, mask) of windows, WINDOW wide; places after a short text's end repeat its last word under a zero mask."""
        place = np.minimum(np.arange(WINDOW)[None, :], self.length[which][:, None] - 1)
        return self.index[self.at[which][:, None] + place], np.arange(WINDOW)[None, :] < self.length[which][:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_model(vocabulary: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    r = lambda *s, scale=0.1: (rng.standard_normal(s) * scale).astype(np.float32)
    m = {"vocabulary": vocabulary, "word": r(len(vocabulary) + 1, WORD_DIM), "char": r(BUCKETS, CHAR_DIM, scale=0.3)}
    for side in ("f", "b"):
        m |= {f"W{side}": r(d, 3 * h, scale=0.3), f"U{side}": r(h, 3 * h, scale=0.3), f"c{side}": np.zeros(3 * h, np.float32)}
    return m | {"att": r(2 * h, scale=0.3), "out": r(2 * h, scale=0.5), "bias": np.full(1, -1.0, np.float32), "shift": np.zeros(1, np.float32)}


def word_inputs(m: dict, c: Corpus, most: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(input vectors, vocabulary index) of the distinct words."""
    v = m["vocabulary"]
    at = np.searchsorted(v, c.hashes)
    known = v[np.minimum(at, len(v) - 1)] == c.hashes if len(v) else np.zeros(len(c.hashes), bool)
    at = np.where(known, at, len(v))
    out = np.empty((len(at), WORD_DIM + CHAR_DIM), np.float32)
    out[:, :WORD_DIM] = m["word"][at]
    ends = np.append(c.gram_first, len(c.grams))
    for i in range(0, len(at), most):  # a vector for each gram is the largest thing here
        j = min(i + most, len(at))
        sums = np.add.reduceat(m["char"][c.grams[ends[i] : ends[j]]], ends[i:j] - ends[i], axis=0)
        out[i:j, WORD_DIM:] = sums / c.gram_count[i:j, None]
    return out, at


def evidence(c: Corpus, toxic: np.ndarray, use: np.ndarray) -> np.ndarray:
    """How far each distinct word's share of toxic texts stands out among the texts `use`, positive where toxic texts hold it more often.

    For n texts with the word, of which a share s is toxic where b is usual, n * KL(s || b) bounds minus the logarithm of the
    chance of such a share; the logarithm of the number of words in three texts or more is taken off, so that what many words
    find by chance is 0. Rarer words have none.
    """
    words = len(c.hashes)
    n, hits = np.zeros(words, np.int64), np.zeros(words, np.int64)
    for i, j in _runs(c.first, PAIRS):  # distinct words of texts, some texts at a time
        pairs = np.unique(np.repeat(np.arange(i, j), np.diff(c.first[i : j + 1])) * words + c.index[c.first[i] : c.first[j]])
        pairs = pairs[use[pairs // words]]
        np.add.at(n, pairs % words, 1)
        np.add.at(hits, pairs[toxic[pairs // words]] % words, 1)
    usual = toxic[use].mean()
    share = hits / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(share > 0, share * np.log(share / usual), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - usual)), 0)
    return np.sign(share - usual) * np.maximum(n * gain - np.log(max((n >= 3).sum(), 1)), 0) * (n >= 3)


def _pass(x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, u: np.ndarray, back: bool, keep: bool):
    """States (time, windows, HIDDEN) of one direction. x: projected distinct words."""
    h3 = HIDDEN
    h = np.zeros((len(index), h3), np.float32)
    states = np.empty((WINDOW, len(index), h3), np.float32)
    kept = []
    for t in range(WINDOW - 1, -1, -1) if back else range(WINDOW):
        g = x[index[:, t]]
        hu = h @ u
        zr = g[:, : 2 * h3] + hu[:, : 2 * h3]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :h3], zr[:, h3:]
        n = r * hu[:, 2 * h3 :]
        n += g[:, 2 * h3 :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if mask is not None:
            new = np.where(mask[:, t, None], new, h)
        if keep:
            kept.append((t, h, z, r, n, hu[:, 2 * h3 :]))
        states[t] = h = new
    return states, kept


def _projected(m: dict, x: np.ndarray, side: str) -> np.ndarray:
    out = x @ m[f"W{side}"]
    out += m[f"c{side}"]
    return out


def forward(m: dict, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """Logits of windows, and what the gradient needs."""
    f, kf = _pass(_projected(m, x, "f"), index, mask, m["Uf"], False, keep)
    b, kb = _pass(_projected(m, x, "b"), index, mask, m["Ub"], True, keep)
    h = HIDDEN
    ends = np.stack([m["att"], m["out"]], axis=1)
    both = f.reshape(-1, h) @ ends[:h] + b.reshape(-1, h) @ ends[h:]
    a, y = both[:, 0].reshape(f.shape[:2]), both[:, 1].reshape(f.shape[:2])  # (time, windows)
    if mask is not None:
        a = np.where(mask.T, a, -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    # attention pooling and the linear layer commute
    return (a * y).sum(axis=0) + m["bias"][0], (f, b, a, y, kf, kb)


def gradients(m: dict, c: Corpus, x: np.ndarray, at: np.ndarray, index: np.ndarray, mask: np.ndarray, weight_error: np.ndarray, saved, dropped: np.ndarray) -> dict[str, np.ndarray]:
    f, b, a, y, kf, kb = saved
    h = HIDDEN
    mean = (a * y).sum(axis=0)
    dy = a * weight_error
    da = a * (y - mean) * weight_error
    g = {"bias": np.array([weight_error.sum()], np.float32)}
    g["out"] = np.concatenate([np.einsum("tn,tnh->h", dy, s) for s in (f, b)])
    g["att"] = np.concatenate([np.einsum("tn,tnh->h", da, s) for s in (f, b)])
    dx = np.zeros_like(x)
    for side, kept, part in (("f", kf, slice(0, h)), ("b", kb, slice(h, 2 * h))):
        u, w = m[f"U{side}"], m[f"W{side}"]
        du, dproj = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
        dh = np.zeros((len(index), h), np.float32)
        out, att = m["out"][part], m["att"][part]
        pre_all, idx_all = [], []
        for t, prev, z, r, n, hn in reversed(kept):
            dh = dh + dy[t][:, None] * out + da[t][:, None] * att
            on = mask[:, t, None]
            dnew = np.where(on, dh, 0)
            dn = dnew * (1 - z) * (1 - n * n)
            dz = dnew * (prev - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            pre = np.concatenate([dz, dr, dn], axis=1)
            back = np.concatenate([dz, dr, dn * r], axis=1)
            du += prev.T @ back
            dh = np.where(on, dnew * z + back @ u.T, dh)
            pre_all.append(pre)
            idx_all.append(index[:, t])
        pre, idx = np.concatenate(pre_all), np.concatenate(idx_all)
        order = np.argsort(idx, kind="stable")
        heads = np.flatnonzero(np.diff(idx[order], prepend=-1))
        dproj[idx[order][heads]] = np.add.reduceat(pre[order], heads, axis=0)
        g |= {f"U{side}": du, f"W{side}": x.T @ dproj, f"c{side}": dproj.sum(axis=0)}
        dx += dproj @ w.T
    dx *= dropped
    g["word"] = np.zeros_like(m["word"])
    np.add.at(g["word"], at, dx[:, :WORD_DIM])
    dc = dx[:, WORD_DIM:] / c.gram_count[:, None]
    touched = np.unique(c.owner[np.isin(c.owner, np.unique(index))])
    use = np.isin(c.owner, touched)
    g["char"] = np.zeros_like(m["char"])
    np.add.at(g["char"], c.grams[use], dc[c.owner[use]])
    return g


def window_logits(m: dict, c: Corpus, which: np.ndarray | None = None, most: int = 2048) -> np.ndarray:
    which = np.arange(len(c.text)) if which is None else which
    x, _ = word_inputs(m, c)
    out = np.empty(len(which), np.float32)
    short = c.length[which] < WINDOW
    for group, masked in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
        for i in range(0, len(group), most):
            part = group[i : i + most]
            index, mask = c.rows(which[part])
            out[part] = forward(m, x, index, mask if masked else None)[0]
    return out


def text_logits(m: dict, c: Corpus, n: int) -> np.ndarray:
    """The worst window's logit of each of n texts, minus infinity for texts without words."""
    out = np.full(n, -np.inf)
    if len(c.text):
        np.maximum.at(out, c.text, window_logits(m, c))
    return out + m["shift"][0]


def train(texts: list[str], toxic: list[int], steps: int = STEPS, seed: int = 5) -> dict[str, np.ndarray]:
    """A model of labelled texts. It is the same for the same texts in the same order."""
    y = np.array(toxic, bool)
    empty = {"vocabulary": np.zeros(0, np.uint64), "constant": np.array([y.mean() if len(y) else 0.0])}
    if not y.any() or y.all():
        return empty
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    data = b"".join(data)
    c = Corpus(np.frombuffer(data, np.uint8), offsets, READ_BYTES)
    del data
    counts = np.bincount(c.index, minlength=len(c.hashes))
    top = np.argsort(-counts, kind="stable")[:VOCABULARY]
    m = new_model(np.sort(c.hashes[top[counts[top] >= 3]]))
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    if held[y].sum() < 40:  # too few to set the shift by: use all for both
        held[:] = False
    mine = [np.flatnonzero((y[c.text] == k) & ~held[c.text]) for k in (False, True)]
    if not len(mine[0]) or not len(mine[1]):
        return empty
    told = np.clip(evidence(c, y, ~held) / 10, -EVIDENCE, EVIDENCE).astype(np.float32)
    at = np.searchsorted(c.hashes, m["vocabulary"])
    m["word"][:-1, 0] = told[at]
    sums = np.concatenate([np.zeros(1), np.cumsum(told[c.index], dtype=float)])
    part = mine[1]
    order = np.lexsort((sums[c.at[part]] - sums[c.at[part] + c.length[part]], c.text[part]))
    worst: list[np.ndarray] = [mine[0], part[order[np.flatnonzero(np.diff(c.text[part][order], prepend=-1))]]]
    moments: dict[str, list[np.ndarray]] = {}
    refresh = max(steps // 8, 1)
    for step in range(steps):
        if step and step % refresh == 0:
            for k in (0, 1):
                part = mine[k] if k else rng.choice(mine[0], min(len(mine[0]), 12_000), replace=False)
                logit = window_logits(m, c, part)
                order = np.lexsort((-logit, c.text[part]))
                head = np.flatnonzero(np.diff(c.text[part][order], prepend=-1))
                best = order[head]
                if k:
                    worst[1] = part[best]
                else:
                    worst[0] = part[np.argsort(-logit)[: max(len(part) // 10, 32)]]
        half = BATCH // 2
        pos = rng.choice(worst[1], half)
        neg = np.concatenate([rng.choice(mine[0], half - half // 3), rng.choice(worst[0], half // 3)])
        which = np.concatenate([pos, neg])
        label = np.repeat([1.0, 0.0], [half, half]).astype(np.float32)
        index, mask = c.rows(which)
        used, index = np.unique(index, return_inverse=True)
        index = index.reshape(len(which), WINDOW)
        part = _some(c, used)
        x, at = word_inputs(m, part)
        keep = (rng.random(x.shape) > DROPOUT).astype(np.float32) / np.float32(1 - DROPOUT)
        x *= keep
        logit, saved = forward(m, x, index, mask, keep=True)
        error = (_sigmoid(logit) - label) / len(label)
        g = gradients(m, part, x, at, index, mask, error, saved, keep)
        rate = 0.02 * (1 - 0.85 * step / steps)
        for name, d in g.items():
            if name in ("word", "char") and step < steps * WARM:
                continue
            if name not in moments:
                moments[name] = [np.zeros_like(m[name]), np.zeros_like(m[name])]
            a, b = moments[name]
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            m[name] = m[name] - rate * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(b / (1 - 0.99 ** (step + 1))) + 1e-6)
            if name in ("word", "char"):
                m[name] *= np.float32(1 - 2e-4)
    check = held if held.any() else np.ones(len(y), bool)
    logit = text_logits(m, c, len(y))
    pos, neg = np.sort(logit[check & y]), np.sort(logit[check & ~y & np.isfinite(logit)])
    cuts = np.unique(np.concatenate([pos, neg]))
    if len(cuts) > 1:  # the cut with fewest errors, halfway to the next lower value; among equals the middle
        mid = (cuts[1:] + cuts[:-1]) / 2
        errors = np.searchsorted(pos, mid) + (len(neg) - np.searchsorted(neg, mid))
        best = mid[errors == errors.min()]
        m["shift"] = np.array([np.log(THRESHOLD / (1 - THRESHOLD)) - best[len(best) // 2]], np.float32)
    return m


def _some(c: Corpus, words: np.ndarray) -> Corpus:
    """The distinct words `words` of c, with their character grams only."""
    part = object.__new__(Corpus)
    part.hashes = c.hashes[words]
    ends = np.append(c.gram_first, len(c.grams))
    n = (ends[1:] - ends[:-1])[words]
    first = np.cumsum(n) - n
    part.owner = np.repeat(np.arange(len(words)), n)
    part.grams = c.grams[ends[words][part.owner] + np.arange(int(n.sum())) - first[part.owner]]
    part.gram_first, part.gram_count = first, c.gram_count[words]
    return part


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """A model from a bounded sample of labelled documents of docs that are not held out; warns where one kind is missing."""
    kinds = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    there = docs.where(F.octet_length("text") > 0).select(F.col("doc_id").alias("__there"))
    held = kinds.join(there, F.col("doc_id") == F.col("__there"), "left_semi")  # ids only: no text is shuffled
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    some = [held.where(rule).orderBy(*order).limit(n) for rule, n in (("toxic > 0", SAMPLE_TOXIC), ("toxic <= 0", SAMPLE_CLEAN))]
    chosen = some[0].unionByName(some[1]).withColumn("__toxic", (F.col("toxic") > 0).cast("int")).select(F.col("doc_id").alias("__id"), "__toxic")
    met = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    met = met.where(F.length("text") <= LONGEST).select("doc_id", F.col("text").cast("string").alias("text"), "__toxic", F.md5("text").alias("__md5"))
    first = [*order, F.col("__md5")]
    upto = Window.orderBy(*first).rowsBetween(Window.unboundedPreceding, 0)  # over the rows of the sample alone
    found = [
        met.where(F.col("__toxic") == k).orderBy(*first).limit(n).withColumn("__chars", F.sum(F.length("text")).over(upto)).where(F.col("__chars") <= SAMPLE_CHARS).orderBy("__chars").select("text", "__toxic")
        for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    ]
    rows = found[0].collect() + found[1].collect()
    toxic = sum(r["__toxic"] for r in rows)
    if toxic in (0, len(rows)):
        warnings.warn(f"toxicity: {toxic} toxic and {len(rows) - toxic} clean labelled texts in docs; every text scores the share of toxic ones", RuntimeWarning, stacklevel=2)
    return train([r["text"] for r in rows], [r["__toxic"] for r in rows])


def _judged(m: dict, batch: pa.RecordBatch, rows: int = 128):
    """(from, rows, scores) of runs of a batch's rows: few texts become Python strings at a time, few bytes are read at once."""
    for at in range(0, batch.num_rows, rows):
        for i, j, data, offsets in blocks(batch["text"].slice(at, rows).to_pylist(), BLOCK_BYTES):
            c = Corpus(data, offsets)
            if "constant" in m:
                score = np.zeros(j - i)
                score[np.unique(c.text)] = m["constant"][0]
            else:
                score = _sigmoid(text_logits(m, c, j - i).astype(float))
            yield at + i, j - i, score


def _scoring(blob: bytes):
    def run(batches):
        m = pickle.loads(blob)
        for batch in batches:
            for i, n, score in _judged(m, batch):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, n), batch["held_out"].slice(i, n), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def scores(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    out = in_batches(rows, _scoring(pickle.dumps(model)), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _keeping(blob: bytes):
    def run(batches):
        m = pickle.loads(blob)
        for batch in batches:
            for i, n, score in _judged(m, batch):
                yield batch.slice(i, n).filter(pa.array(score < THRESHOLD))

    return run


def clean(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The rows of docs that are not predicted toxic, in one pass over the texts."""
    return in_batches(docs, _keeping(pickle.dumps(model)), docs.schema)
