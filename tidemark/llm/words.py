"""Words and shingles of whole texts as 64-bit hashes, in numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = U(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * U(2) + U(1)


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 1 << 21)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of texts with about `most` bytes; one longer text is a run of its own."""
    data, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        if data and size + len(b) > most:
            yield first, i, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
            data, size, first = [], 0, i
        data.append(b)
        size += len(b)
    if data:
        yield first, len(texts), np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def separators(also: bytes = b"") -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*b" \t\n\x0b\x0c\r", *also]] = True
    return table


def segment_hash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[starts[i]:starts[i+1]], the same wherever the run stands; zeros at its end do not count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(values)
    inverse = pow(_P, -1, 1 << 64)
    sums = np.add.reduceat(values * _power(_P, n), starts)
    return mix(sums * _power(inverse, n)[starts])


def hashed_words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word and the index of each text's first word (one more at the end)."""
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        data = fold[data]
    n = len(data)
    inside = ~sep[data]
    begins, ends = np.ones(n, bool), np.ones(n, bool)  # a word cannot go on from the byte before, or to the one after
    begins[1:], ends[:-1] = ~inside[:-1], ~inside[1:]
    begins[offsets[offsets < n]] = True
    ends[offsets[offsets > 0] - 1] = True
    starts = np.flatnonzero(inside & begins)
    ends = np.flatnonzero(inside & ends) + 1
    values = _bytes_table()[data]
    values[~inside] = 0
    return segment_hash(values, starts), starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a text with fewer words has one shingle, the whole."""
    total = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        total = total * _Q + words[j : j + len(total)]
    total = mix(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(total[a : b - k + 1]))
        elif b > a:
            h = U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _Q + w
            out.append(mix(np.array([h ^ U(0xA5A5A5A5A5A5A5A5)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
