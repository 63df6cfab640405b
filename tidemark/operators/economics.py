"""Exposure paths set against simple strategies and against themselves at other times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled
from . import quantiles
from .forecasts import HKEYS, exposure, graded, growth, replay, roi, signals
from .series import beside, carried, dealt, indexed

c = F.col
#: Bars of a block of prices and of exposures whose shifts are summed together: some 200 MB in a task.
TILE = 1 << 20


def executed(forecasts: DataFrame, bars: DataFrame, policy: dict[str, float] | None = None) -> DataFrame:
    """The exposure path: signals that get the open and close of the bar after their own, graded in order, with the exposure held.

    A signal without a next bar, or with prices of 0 there, is dropped before it is graded.
    """
    after = indexed(bars.select("symbol", "interval", "open_time", "open", "close")).select("symbol", "interval", (c("idx") - 1).alias("idx"), c("open").alias("next_open"), c("close").alias("next_close"))
    rows = signals(forecasts).join(after, ["symbol", "interval", "idx"]).where("next_open > 0 and next_close > 0")
    fields = [*HKEYS, "open_time", "idx", "verdict", "next_open", "next_close"]
    return settled(exposure(settled(graded(rows, HKEYS, "idx").select(*fields)), policy))


def buy_and_hold(path: DataFrame, cost: float, keys: list[str] = HKEYS) -> DataFrame:
    """Bought at the first executed open, at one cost, and held to the last close."""
    out = path.groupBy(*keys).agg(F.min(F.struct("idx", "next_open")).getField("next_open").alias("entry"), F.max(F.struct("idx", "next_close")).getField("next_close").alias("exit"))
    return out.withColumn("roi", c("exit") / c("entry") * (1 - cost) - 1)


def momentum(bars: DataFrame, lookback: int, cost: float = 0.002) -> DataFrame:
    """Fully in while the close is above the one `lookback` bars ago, replayed over the closes."""
    keys = ["symbol", "interval"]
    rows = beside(indexed(bars.select(*keys, "open_time", "close")), {"exposure": lambda w: F.when(c("close") > F.lag("close", lookback).over(w), 1.0).otherwise(0.0)}, keys, "idx", back=lookback)
    return roi(replay(rows, cost, keys, "close"), keys)


def path_stats(path: DataFrame) -> DataFrame:
    """Deepest fall from the highest value so far and the yearly Sharpe ratio of a replayed path."""
    rows = carried(path.where("f is not null"), "sum", {"level": growth(c("f"))}, HKEYS)
    rows = carried(rows, "max", {"peak": c("level")}, HKEYS)
    sharpe = F.try_divide(F.avg(c("f") - 1), F.stddev_samp(c("f") - 1)) * F.sqrt(F.lit(365.0))
    return rows.groupBy(*HKEYS).agg((-F.min(F.exp(c("level") - c("peak")) + F.lit(-1.0))).alias("max_drawdown"), sharpe.alias("sharpe"))


def constant_exposure(path: DataFrame, cost: float) -> DataFrame:
    """The path's mean exposure bought once, at one cost, at the first mark and held to the last."""
    at = lambda pick: pick(F.struct("idx", "next_close")).getField("next_close")
    rows = path.groupBy(*HKEYS).agg(F.avg("exposure").alias("exposure"), at(F.min).alias("first"), at(F.max).alias("last"))
    return rows.select(*HKEYS, "exposure", (c("exposure") * ((1 - cost) * c("last") / c("first") - 1)).alias("roi"))


def _spectra(marks: np.ndarray, kinds: np.ndarray, size: int) -> np.ndarray:
    """Sums over i of marks[kind of e_(i + s), i], for every shift s of a circle of `size`: a correlation a kind, added up before the way back.

    marks: a row of values of the returns' block for each kind; kinds: the kind of each exposure of the other block.
    """
    total = np.zeros(size // 2 + 1, complex)
    for k, row in enumerate(marks):
        total += np.conj(np.fft.rfft(row, size)) * np.fft.rfft((kinds == k).astype(float), size)
    return np.fft.irfft(total, size)


def _shifted(cost: float):
    """Sums of log growth and numbers of ruined steps by shift, of a block of returns (from place `at`) and a block of exposures (from `start`).

    A step depends on its return and on the pair of exposure and turnover, of which a policy has a few; so the sum over a block at every
    shift is one circular correlation a pair. Nothing is held before the first return, which is put right place by place.
    """

    def run(blocks):
        for pdf in blocks:
            for row in pdf.itertuples(index=False):
                r, e, turn = (np.asarray(x, float) for x in (row.r, row.e, row.turn))
                pairs, kinds = np.unique(np.stack([e, turn]), axis=1, return_inverse=True)
                kinds = kinds.ravel()
                f = 1 + pairs[0][:, None] * r - pairs[1][:, None] * cost
                size = 1 << int(np.ceil(np.log2(len(r) + len(e))))
                log = lambda v: np.where(v > 0, np.log(np.where(v > 0, v, 1.0)), 0.0)
                growth = _spectra(log(f), kinds, size)
                ruined = np.rint(_spectra((f <= 0).astype(float), kinds, size)).astype(np.int64) if (f <= 0).any() else np.zeros(size, np.int64)
                if row.at == 0:
                    own, other = 1 + r[0] * e - np.abs(e) * cost, 1 + r[0] * e - turn * cost
                    growth[: len(e)] += log(own) - log(other)
                    ruined[: len(e)] += (own <= 0).astype(np.int64) - (other <= 0)
                # Shift 0 of the circle sets e[0] on r[0]; the last len(r) - 1 places stand for shifts below it.
                far = np.concatenate([np.arange(len(e)), np.arange(1 - len(r), 0)])
                shift = (row.start - row.at + far) % row.n
                yield pd.DataFrame({"symbol": row.symbol, "interval": row.interval, "horizon": row.horizon, "shift": shift, "growth": growth[far], "ruined": ruined[far]})

    return run


def mistimed(path: DataFrame, cost: float = 0.002) -> DataFrame:
    """All circular shifts of the exposures against the same prices: samples, percentile of the real timing (ties half), median ROI.

    A path of n bars has n - 1 shifts of n - 1 steps. Returns and exposures are cut into blocks of TILE bars; a row of the join is a pair of
    blocks, whose shifts are summed by Fourier transform: n log n for the pairs of (exposure, turnover), of which a policy's grades make a
    few dozen. No task holds more than two blocks. Log growths that differ by less than 1e-9 are ties.
    """
    rows = settled(replay(path, cost))
    before = beside(rows, {"last_exposure": lambda w: F.lag("exposure").over(w)}, HKEYS, back=1)
    n = rows.groupBy(*HKEYS).agg(F.max("pos").alias("top"), F.max(F.struct("pos", "exposure")).getField("exposure").alias("end")).where("top >= 2")
    rows = before.join(n, HKEYS).withColumns({"n": c("top") + 1, "turned": F.round(F.abs(c("exposure") - F.coalesce("last_exposure", "end")), 12), "tile": F.floor(c("pos") / TILE)})
    marks = beside(rows, {"later": lambda w: F.lead("next_close").over(w)}, HKEYS, ahead=1).withColumn("r", c("later") / c("next_close") - 1).where("r is not null")
    gathered = lambda of, *fields: of.groupBy(*HKEYS, "tile", "n").agg(F.min("pos").alias("lowest"), F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("rows"))
    left = gathered(marks, "r").select(*HKEYS, "n", c("lowest").alias("at"), c("rows.r").alias("r"))
    right = gathered(rows, "exposure", "turned").select(*HKEYS, c("lowest").alias("start"), c("rows.exposure").alias("e"), c("rows.turned").alias("turn"))
    pairs = left.join(right, HKEYS)
    parts = dealt(pairs).mapInPandas(_shifted(cost), "symbol string, interval string, horizon string, shift long, growth double, ruined long")
    shifts = parts.groupBy(*HKEYS, "shift").agg(F.sum("growth").alias("growth"), F.sum("ruined").alias("ruined"))
    shifts = settled(shifts.withColumn("growth", F.when(c("ruined") > 0, float("-inf")).otherwise(c("growth"))))
    real = shifts.where("shift = 0").select(*HKEYS, c("growth").alias("real"))
    met = shifts.where("shift > 0").join(real, HKEYS)
    tie = (c("growth") == c("real")) | (F.abs(c("growth") - c("real")) <= 1e-9)
    ranks = met.groupBy(*HKEYS).agg(F.count(F.lit(1)).alias("samples"), (100 * F.sum(F.when(tie, 0.5).when(c("growth") < c("real"), 1.0).otherwise(0.0)) / F.count(F.lit(1))).alias("percentile"), (F.exp(F.max("real")) - 1).alias("roi"))
    middle = quantiles.whole(shifts.where("shift > 0").withColumn("value", F.exp("growth") - 1), HKEYS, "value", 0.5, "median_roi")
    return ranks.join(middle, HKEYS)


def summary(path: DataFrame, bars: DataFrame, cost: float = 0.002, lookback: int = 7, most: float = float("inf")) -> DataFrame:
    """One row a path: its ROI beside holding, a constant exposure, its own shifts and the momentum rule, and its deepest fall. ROIs of replays count `most` at most."""
    rows = settled(replay(path, cost))
    out = roi(rows).select(*HKEYS, F.least("roi", F.lit(most)).alias("roi"))
    for name, other in (("hold_roi", buy_and_hold(path, cost)), ("constant_roi", constant_exposure(path, cost))):
        out = out.join(other.select(*HKEYS, c("roi").alias(name)), HKEYS)
    out = out.join(momentum(bars, lookback, cost).select("symbol", "interval", F.least("roi", F.lit(most)).alias("momentum_roi")), ["symbol", "interval"])
    out = out.join(mistimed(path, cost).select(*HKEYS, "percentile"), HKEYS, "left").join(path_stats(rows), HKEYS, "left")
    return out.select(*HKEYS, "roi", *[(c("roi") - c(f"{x}_roi")).alias(f"over_{x}") for x in ("hold", "constant", "momentum")], "percentile", "max_drawdown")
