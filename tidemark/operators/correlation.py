"""Correlations of all pairs of symbols from blocked Gram matrices.

Instants are dealt to blocks by their hash, symbols to blocks by theirs; a task fills two matrices (symbols of a block by the instants of a
block) and multiplies them, so it yields the numbers, sums and products of all their pairs at once. These are added up by pair: what is
shuffled grows with the rows, and with the pairs once a block of instants, never once an instant. Values are taken from their symbol's
mean, so sums of squares keep their digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
#: Rows of a block of instants, and symbols of a block.
BLOCK_ROWS, BLOCK_SYMBOLS = 400_000, 256
SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _gram(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times, at = np.unique(pdf["open_time"].to_numpy(), return_inverse=True)
        first, second = (int(pdf[k].iloc[0]) for k in ("one", "two"))
        filled = []
        for block in (first, second):
            mine = (pdf["block"] == block).to_numpy()
            names, row = np.unique(pdf["symbol"].to_numpy()[mine].astype(str), return_inverse=True)
            value, there = np.zeros((2, len(names), len(times)))
            value[row, at[mine]], there[row, at[mine]] = pdf["v"].to_numpy(float)[mine], 1.0
            filled.append((names, value, there))
        (a, x, m), (b, y, k) = filled
        sums = (m @ k.T, x @ k.T, m @ y.T, (x * x) @ k.T, m @ (y * y).T, x @ y.T)
        i, j = np.nonzero((sums[0] > 0) & (a[:, None] < b[None, :]) if first == second else sums[0] > 0)
        # Pairs are named in order of their symbols, so those of two blocks may have to change sides.
        swap = a[i] > b[j]
        side = dict(zip(SUMS, (s[i, j] for s in sums), strict=True))
        for p, q in (("x", "y"), ("xx", "yy")):
            side[p], side[q] = np.where(swap, side[q], side[p]), np.where(swap, side[p], side[q])
        return pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"s1": np.where(swap, b[j], a[i]), "s2": np.where(swap, a[i], b[j])} | side, index=range(len(i)))

    return run


def pairs(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, s1, s2, n (instants that both have), r (null where either does not move) of rows (keys, symbol, open_time, value), one a symbol and instant."""
    rows = rows.select(*keys, "symbol", "open_time", c(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("s"))
    n, s = sizes.agg(F.max("n"), F.max("s")).first()  # two numbers
    times, blocks = max(1, -(-(n or 0) // BLOCK_ROWS)), max(1, -(-(s or 0) // BLOCK_SYMBOLS))
    mean = rows.groupBy(*keys, "symbol").agg(F.avg("v").alias("mean"))
    rows = rows.join(mean, [*keys, "symbol"]).withColumns({"v": c("v") - c("mean"), "block": F.pmod(F.xxhash64("symbol"), F.lit(blocks)), "time": F.pmod(F.xxhash64("open_time"), F.lit(times))}).drop("mean")
    others = F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")
    met = rows.withColumn("other", F.explode(others)).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    sums = met.groupBy(*keys, "time", "one", "two").applyInPandas(_gram(keys), f"{kinds}, s1 string, s2 string, {', '.join(f'{x} double' for x in SUMS)}")
    got = sums.groupBy(*keys, "s1", "s2").agg(*[F.sum(x).alias(x) for x in SUMS])
    xx, yy, xy = c("xx") - c("x") ** 2 / c("n"), c("yy") - c("y") ** 2 / c("n"), c("xy") - c("x") * c("y") / c("n")
    moves = (xx > 1e-12 * c("xx")) & (yy > 1e-12 * c("yy"))
    return got.select(*keys, "s1", "s2", c("n").cast("long").alias("n"), F.when(moves, xy / F.sqrt(xx * yy)).alias("r"))


def return_correlation(labels: DataFrame, least: int = 30) -> DataFrame:
    """Per horizon: symbols, pairs with enough shared and moving returns, and their mean correlation; 0 without a pair."""
    found = pairs(labels, "fwd_return", ["horizon"]).where((c("n") >= least) & c("r").isNotNull())
    found = found.groupBy("horizon").agg(F.count(F.lit(1)).alias("pairs"), F.avg("r").alias("correlation"))
    symbols = labels.groupBy("horizon").agg(F.count_distinct("symbol").alias("symbols"))
    return symbols.join(found, "horizon", "left").fillna({"pairs": 0, "correlation": 0.0})


def common_correlation(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, dates, correlation): mean correlation of `value` over all pairs of symbols, on the times that all of them share."""
    n = rows.groupBy(*keys).agg(F.count_distinct("symbol").alias("symbols"))
    shared = rows.groupBy(*keys, "open_time").agg(F.count_distinct("symbol").alias("here")).join(n, keys).where(c("here") == c("symbols")).select(*keys, "open_time")
    found = pairs(rows.join(shared, [*keys, "open_time"], "left_semi"), value, keys)
    return found.groupBy(*keys).agg(F.max("n").alias("dates"), F.avg("r").alias("correlation"))
