"""Rollups to coarser intervals, scans and unions of bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domain import INTERVALS

c = F.col


def bucket(interval: str, at: str | Column = "open_time") -> Column:
    """Start of the interval's bucket: aligned to the epoch, weeks to Monday."""
    if interval == "1w":
        return F.date_trunc("week", at)
    size = INTERVALS[interval] * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(at) / size) * size)


def _aggs(columns: list[str]) -> list[Column]:
    """First open and last close of bars that have them and a time, as SQL picks them; extremes and sums."""
    known = lambda x: F.when(c("open_time").isNotNull() & c(x).isNotNull(), F.struct("open_time", x))
    out = [F.min(known("open")).getField("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(known("close")).getField("close").alias("close")]
    out += [F.sum(x).alias(x) for x in ("volume", "quote_asset_volume", "num_trades", "taker_buy_base_volume", "taker_buy_quote_volume") if x in columns]
    return [*out, F.count(F.lit(1)).alias("n_source_bars")]


def rollup(bars: DataFrame, interval: str) -> DataFrame:
    """Bars of a coarser interval. First and last are minima of (time, value), so the work is done before the shuffle."""
    return bars.groupBy("symbol", bucket(interval).alias("bucket")).agg(*_aggs(bars.columns)).withColumnRenamed("bucket", "open_time").withColumn("interval", F.lit(interval))


def rollup_many(bars: DataFrame, intervals: list[str]) -> DataFrame:
    """Several intervals from one read of the source."""
    at = F.array(*[F.struct(F.lit(i).alias("i"), bucket(i).alias("at")) for i in intervals])
    rows = bars.drop("interval").withColumn("b", F.explode(at))
    return rows.groupBy("symbol", c("b.i").alias("interval"), c("b.at").alias("bucket")).agg(*_aggs(bars.columns)).withColumnRenamed("bucket", "open_time")


def asked(text: str | list[str]) -> list[str]:
    """Intervals from a list, or from text that parts them by commas or spaces; each once, in order."""
    parts = " ".join([text] if isinstance(text, str) else map(str, text)).replace(",", " ").split()
    return list(dict.fromkeys(parts))


def rollup_each(bars: DataFrame, text: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Bars of the intervals that were asked for, and (interval, symbol, bars, error) of each: an unknown one stops none of the others.

    An interval finer than the source, or none that is known, has an error; so has a symbol without a row at a known one.
    """
    wanted = asked(text)
    source = bars.select("symbol", "interval").distinct()
    known = [i for i in wanted if i in INTERVALS]
    minutes = F.create_map(*[F.lit(x) for k, v in INTERVALS.items() for x in (k, v)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i in INTERVALS).alias("ok")) for i in wanted])).alias("w")
    plan = source.select("symbol", "interval", each).select("symbol", c("interval").alias("source"), c("w.i").alias("interval"), c("w.ok").alias("ok"))
    finer = c("ok") & (F.try_element_at(minutes, c("interval")) < F.try_element_at(minutes, c("source")))
    plan = plan.withColumn("error", F.when(~c("ok"), "unsupported interval").when(finer, "finer than the source"))
    made = rollup_many(bars, known) if known else bars.limit(0).drop("interval").withColumn("interval", F.lit(""))
    made = made.join(plan.where("error IS NULL").select("symbol", "interval"), ["symbol", "interval"], "left_semi")
    counts = made.groupBy("symbol", "interval").agg(F.count(F.lit(1)).alias("bars"))
    report = plan.join(counts, ["symbol", "interval"], "left").fillna(0, ["bars"])
    return made, report.select("interval", "symbol", "bars", F.coalesce("error", F.when(c("bars") == 0, "no bars")).alias("error"))


def scan(bars: DataFrame, filters: list[tuple[str, str, object]]) -> DataFrame:
    """Filters (column, one of == >= <= > <, value), all of them."""
    ops = {"==": lambda a, b: a == b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
    return reduce(lambda rows, f: rows.where(ops[f[1]](c(f[0]), F.lit(f[2]))), filters, bars)


def normalize_time(epoch: Column) -> Column:
    """Milliseconds, or microseconds from 1e15 on, as a time."""
    return F.when(epoch >= 10**15, F.timestamp_micros(epoch)).otherwise(F.timestamp_millis(epoch))


def union_versions(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_wins(rows: DataFrame, ordinal: str) -> DataFrame:
    """One row for each bar: the first ingested."""
    w = Window.partitionBy("symbol", "interval", "open_time").orderBy(ordinal)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The newest n bars (1 to 5000) of each series; of bars with one time the last by close."""
    once = Window.partitionBy("symbol", "open_time").orderBy(c("close").desc())
    bars = bars.withColumn("__k", F.row_number().over(once)).where("__k = 1").drop("__k")
    w = Window.partitionBy("symbol").orderBy(c("open_time").desc())
    return bars.withColumn("__k", F.row_number().over(w)).where(c("__k") <= max(1, min(n, 5000))).drop("__k")


def ends(bars: DataFrame, n: int) -> DataFrame:
    """The first and last n bars of each symbol, named head and tail (head where a bar is both)."""
    last = latest(bars, n).select("symbol", "open_time", F.lit(True).alias("late"))
    first = bars.withColumn("__k", F.row_number().over(Window.partitionBy("symbol").orderBy("open_time"))).where(c("__k") <= n).select("symbol", "open_time", F.lit(True).alias("early"))
    met = bars.join(first.join(last, ["symbol", "open_time"], "full"), ["symbol", "open_time"])
    return met.withColumn("part", F.when(c("early"), "head").otherwise("tail")).drop("early", "late")


def symbol_parts(symbols: DataFrame, quotes: list[str]) -> DataFrame:
    pattern = "^(.+)(" + "|".join(sorted(quotes, key=lambda q: (-len(q), q))) + ")$"
    return symbols.select("symbol", F.regexp_extract("symbol", pattern, 1).alias("base"), F.regexp_extract("symbol", pattern, 2).alias("quote"))


def common_dates(bars: DataFrame) -> DataFrame:
    n = bars.agg(F.count_distinct("symbol").alias("n"))
    return bars.groupBy("open_time").agg(F.count_distinct("symbol").alias("k")).join(F.broadcast(n), c("k") == c("n")).select("open_time")
