"""Histogram boosting of many models at once: small ones in a task each, large ones level by level over all tasks.

Rows are binned to a byte a column (`edges`: quantiles of the months that a model looks back on). A tree grows by levels: gradients are
summed by (model, node, column, bin), the sums give each node its best split, and rows go left or right. A model of at most TASK_ROWS
rows does that inside one task. A larger one is cut into pieces of PIECE_ROWS rows: every level is one job, in which tasks add up
the pieces that they hold, the sums of a model meet as one row a task, and only its splits, at most 2^depth of them, come back to the
driver. Gradients are whole multiples of 1 / GRID, so sums are exact in any order and both ways find the same trees.

A model has one score a row (logistic, y 0 or 1) or one a class (softmax; leaves are vectors).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled

c = F.col
BINS, LEAST, GRID = 64, 20, float(1 << 20)
#: Rows up to which a model is fitted in one task, rows of a piece of a larger one, and trees after which its scores are kept.
TASK_ROWS, PIECE_ROWS, KEPT_EVERY = 200_000, 1 << 14, 10


# ---- arrays: what a task does with the rows it holds


def binned(x: np.ndarray, edges: list[np.ndarray], middle: np.ndarray) -> np.ndarray:
    """A byte a value; what is no finite number counts as the column's median."""
    filled = np.where(np.isfinite(x), x, middle)
    return np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, filled.T, strict=True)], axis=1).astype(np.uint8) if x.size else np.zeros(x.shape, np.uint8)


def probabilities(score: np.ndarray) -> np.ndarray:
    if score.shape[1] == 1:
        return 1 / (1 + np.exp(-score))
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """g and h of each class and a 1, on the grid; y is 0 or 1, or the number of a class."""
    p = probabilities(score)
    wanted = y[:, None] if score.shape[1] == 1 else (y[:, None] == np.arange(score.shape[1]))
    return np.rint(np.concatenate([p - wanted, p * (1 - p), np.ones((len(p), 1)) / GRID], axis=1) * GRID)


def histogram(b: np.ndarray, values: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """Sums of values by (node, column, bin), exact as the values are whole numbers."""
    columns = b.shape[1]
    shape = (nodes, columns, BINS, values.shape[1])
    out = np.zeros((values.shape[1], nodes * columns * BINS))
    for at in range(0, len(b), PIECE_ROWS):
        rows = slice(at, at + PIECE_ROWS)
        cells = ((node[rows, None] * columns + np.arange(columns)) * BINS + b[rows]).ravel()
        for k in range(values.shape[1]):
            out[k] += np.bincount(cells, np.repeat(values[rows, k], columns), out.shape[1])
    return np.moveaxis(out.reshape(shape[-1:] + shape[:-1]), 0, -1)


def halved(parents: np.ndarray, b: np.ndarray, values: np.ndarray, node: np.ndarray) -> np.ndarray:
    """`histogram` of a level below parents: of two children the smaller is added up, the other is what it leaves of its parent (exact: whole numbers)."""
    at = np.arange(len(parents))
    rows = np.bincount(node, minlength=2 * len(parents)).reshape(-1, 2)
    small = (rows[:, 1] < rows[:, 0]).astype(np.int64)
    chosen = (node & 1) == small[node >> 1]
    found, whole = (np.moveaxis(x, -1, 0) for x in (histogram(b[chosen], values[chosen], node[chosen] >> 1, len(parents)), parents))
    out = np.empty((whole.shape[0], len(parents), 2, *whole.shape[2:]))
    out[:, at, small], out[:, at, 1 - small] = found, whole - found
    return np.moveaxis(out.reshape(whole.shape[0], -1, *whole.shape[2:]), 0, -1)


def split(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best column, cut (rows of bins up to it go left; BINS: all do) and gain of each node, and the sums of its two children."""
    k = (sums.shape[-1] - 1) // 2
    left = sums.cumsum(axis=2)
    total = left[:, :1, -1:]
    right = total - left
    worth = lambda s: (s[..., :k] ** 2 / (s[..., k : 2 * k] + GRID)).sum(axis=-1)
    gain = (worth(left) + worth(right) - worth(total)) / GRID
    gain[(left[..., -1] < LEAST) | (right[..., -1] < LEAST)] = 0
    flat = gain.reshape(len(sums), -1)
    best = flat.argmax(axis=1)
    found = np.take_along_axis(flat, best[:, None], axis=1)[:, 0]
    column, cut = best // BINS, best % BINS
    children = np.stack([x[np.arange(len(sums)), column, cut] for x in (left, right)], axis=1)
    none = found <= 1e-9  # no split: all go left
    cut[none] = BINS
    children[none, 0], children[none, 1] = total[none, 0, 0], 0
    return column, cut, np.maximum(np.where(none, 0, found), 0), children


def leaves(children: np.ndarray) -> np.ndarray:
    """The step of each leaf, by class."""
    k = (children.shape[-1] - 1) // 2
    flat = children.reshape(-1, children.shape[-1])
    return -flat[:, :k] / (flat[:, k : 2 * k] + GRID)


def descended(b: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    node = np.zeros(len(b), np.int64)
    for column, cut in levels:
        node = 2 * node + (b[np.arange(len(b)), column[node]] > cut[node])
    return node


def base(counts: np.ndarray) -> np.ndarray:
    """First scores: of [rows of 0, rows of 1] the logit, else the logarithms of the classes' shares."""
    share = np.clip(counts / counts.sum(), 1e-6, 1 - 1e-6)
    return np.log(share[1:] / share[:1]) if len(counts) == 2 else np.log(share)


def scored(b: np.ndarray, forest: dict, first: int = 0, score: np.ndarray | None = None) -> np.ndarray:
    """Scores by the trees from `first` on, added to a score of those before."""
    out = np.tile(forest["base"], (len(b), 1)) if score is None else score.copy()
    for levels, value in forest["trees"][first:]:
        out += value[descended(b, levels)]
    return out


def grown(b: np.ndarray, y: np.ndarray, counts: np.ndarray, trees: int, depth: int, rate: float) -> dict:
    """A forest of rows in one task: base, trees and gain by column."""
    forest = {"base": base(counts), "trees": [], "gain": np.zeros(b.shape[1])}
    score = scored(b, forest)
    for _ in range(trees):
        values, node, levels = gradients(score, y), np.zeros(len(b), np.int64), []
        for level in range(depth):
            sums = halved(sums, b, values, node) if level else histogram(b, values, node, 1)
            column, cut, gain, children = split(sums)
            np.add.at(forest["gain"], column, gain)
            levels.append((column, cut))
            node = 2 * node + (b[np.arange(len(b)), column[node]] > cut[node])
        value = rate * leaves(children)
        score += value[node]
        forest["trees"].append((levels, value))
    return forest


def boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]:
    """(probability of y = 1 for rows, gain by column) of plain arrays, with bins from their own quantiles."""
    there = np.where(np.isfinite(x), x, np.nan)
    middle = np.array([np.nanmedian(col) if np.isfinite(col).any() else 0.0 for col in there.T])
    edges = [np.unique(q) for q in np.quantile(np.where(np.isfinite(x), x, middle), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T]
    forest = grown(binned(x, edges, middle), y.astype(np.int64), np.bincount(y.astype(np.int64), minlength=2), trees, depth, rate)
    return lambda rows: probabilities(scored(binned(rows, edges, middle), forest))[:, 0], forest["gain"]


# ---- rows: models that one task can hold, and larger ones


def told(b: np.ndarray) -> list[bytes]:
    """The bytes of each row, as `stacked` takes them."""
    return np.ascontiguousarray(b).view(f"V{b.shape[1]}").ravel().tolist()


def stacked(bins: pd.Series) -> np.ndarray:
    data = np.frombuffer(b"".join(bins), np.uint8)
    return data.reshape(len(bins), -1) if len(bins) else np.zeros((0, 0), np.uint8)


def grown_over(rows: DataFrame, trees: int, depth: int, rate: float, single: bool) -> dict[str, dict]:
    """The forests of models whose rows (model, symbol, open_time, y, bins) are spread over many tasks.

    The driver holds the forests, whose size is that of the models and not of their rows. single: y is 0 or 1.
    """
    spark = rows.sparkSession
    counts: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("model", "y").count().collect():  # one row a model and class
        counts.setdefault(r["model"], {})[r["y"]] = r["count"]
    forests = {}
    for model, n in counts.items():
        kinds = [0, 1] if single else sorted(n)
        forests[model] = {"kinds": kinds, "base": base(np.array([n.get(k, 0) for k in kinds], float)), "trees": [], "gain": None}

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        forest = forests[pdf["model"].iloc[0]]
        b, y = stacked(pdf["bins"]), np.searchsorted(forest["kinds"], pdf["y"].to_numpy(np.int64))
        return pd.DataFrame({"model": pdf["model"].iloc[:1], "b": [b.tobytes()], "y": [y.astype(np.int64).tobytes()], "score": [scored(b, forest).tobytes()]})

    if not forests:
        return {}
    parts = spark.createDataFrame([(m, -(-sum(n.values()) // PIECE_ROWS)) for m, n in counts.items()], "model string, parts long")
    dealt = rows.join(F.broadcast(parts), "model").withColumn("piece", F.pmod(F.xxhash64("symbol", "open_time"), c("parts")))  # one row a model
    pieces = settled(dealt.select("model", "piece", "y", "bins").groupBy("model", "piece").applyInPandas(_packing(forests), "model string, b binary, y binary, score binary"))
    kept = 0  # trees that the pieces' scores hold
    for tree in range(trees):
        levels: dict[str, list] = {model: [] for model in forests}
        for level in range(depth):
            state = spark.sparkContext.broadcast((forests, levels, kept))  # models, not rows
            partial = pieces.mapInPandas(_summing(state, level), "model string, sums binary, columns int, wide int")
            best = partial.groupBy("model").applyInPandas(_choosing(level), "model string, columns int, column array<long>, cut array<long>, gain array<double>, value array<double>")
            for r in best.collect():  # one row a model
                forest, column = forests[r["model"]], np.array(r["column"])
                forest["gain"] = np.zeros(r["columns"]) if forest["gain"] is None else forest["gain"]
                np.add.at(forest["gain"], column, np.array(r["gain"]))
                levels[r["model"]].append((column, np.array(r["cut"])))
                if level == depth - 1:
                    forest["trees"].append((levels[r["model"]], rate * np.array(r["value"]).reshape(2 << level, -1)))
            state.unpersist()
        if (tree + 1) % KEPT_EVERY == 0 and tree + 1 < trees:
            state = spark.sparkContext.broadcast((forests, {}, kept))
            pieces, kept = settled(pieces.mapInPandas(_advancing(state), pieces.schema)), tree + 1
    return forests


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, y and kept scores of a piece."""
    y = np.frombuffer(row.y, np.int64)
    return np.frombuffer(row.b, np.uint8).reshape(len(y), -1), y, np.frombuffer(row.score).reshape(len(y), -1)


def _packing(forests: dict[str, dict]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        forest = forests[pdf["model"].iloc[0]]
        b, y = stacked(pdf["bins"]), np.searchsorted(forest["kinds"], pdf["y"].to_numpy(np.int64))
        return pd.DataFrame({"model": pdf["model"].iloc[:1].tolist(), "b": [b.tobytes()], "y": [y.astype(np.int64).tobytes()], "score": [scored(b, forest).tobytes()]})

    return run


def _summing(state, level: int):
    """Sums by model of all pieces of a task, at the nodes of a level."""

    def run(batches):
        forests, levels, kept = state.value
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                b, y, score = _opened(row)
                values = gradients(scored(b, forests[row.model], kept, score), y)
                found = histogram(b, values, descended(b, levels[row.model]), 1 << level)
                held[row.model] = held[row.model] + found if row.model in held else found
        for model, found in held.items():
            yield pd.DataFrame({"model": [model], "sums": [found.tobytes()], "columns": [found.shape[1]], "wide": [found.shape[3]]})

    return run


def _choosing(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, columns = int(pdf["wide"].iloc[0]), int(pdf["columns"].iloc[0])
        column, cut, gain, children = split(sum(np.frombuffer(x).reshape(1 << level, columns, BINS, wide) for x in pdf["sums"]))
        return pd.DataFrame({"model": pdf["model"].iloc[:1].tolist(), "columns": [columns], "column": [column.tolist()], "cut": [cut.tolist()], "gain": [gain.tolist()], "value": [leaves(children).ravel().tolist()]})

    return run


def _advancing(state):
    """Scores by the trees grown since they were kept."""

    def run(batches):
        forests, _, kept = state.value
        for pdf in batches:
            scores = []
            for row in pdf.itertuples(index=False):
                b, _, score = _opened(row)
                scores.append(scored(b, forests[row.model], kept, score).tobytes())
            yield pdf.assign(score=scores)

    return run
