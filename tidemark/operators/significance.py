"""Overlap-aware block bootstrap of algebraic statistics, p-values, false discovery rates, correlations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled
from .series import carried, dealt, numbered

c = F.col
#: Draws of an interval, of a p-value, and of the p-values that survive a correction; blocks that a series has at least.
RESAMPLES, P_RESAMPLES, PRECISE_RESAMPLES, LEAST_BLOCKS = 2000, 20_000, 200_000, 10
#: Values (rows times columns, some 50 MB) up to which the block sums go to the draws; beyond it the draws go to them.
LOOKUP_VALUES = 4_000_000
CHANCE, DISCOVERIES = 0.5, 0.05
SERIES = ["symbol", "horizon"]


def hits(quality: DataFrame, keys: list[str] = SERIES, also: tuple[str, ...] = ()) -> DataFrame:
    """(keys, forward, pos, x): hits of the scored rows, numbered in time order."""
    rows = quality.where("status = 'scored'").select(*keys, *also, "forward", "idx", c("correct").cast("double").alias("x"))
    return settled(numbered(settled(rows), keys))


def resampled(rows: DataFrame, keys: list[str], values: list[str], resamples: int = RESAMPLES, stretch: int = 1) -> DataFrame:
    """(keys, b, n, values): sums of the values over each moving-block resample of rows (keys, forward, pos, values).

    Blocks are one horizon (times `stretch`) long and start at md5(keys, resample, slot); a resample has as many rows as its
    series, so its last block is cut short. Block sums are differences of prefix sums, one row for each start, so a draw costs one
    lookup whatever the block's length. Series of fewer than LEAST_BLOCKS blocks have no rows.
    """
    base = rows.groupBy(*keys).agg((F.max("forward") * stretch).cast("long").alias("block"), F.count(F.lit(1)).alias("n"))
    able = settled(base.where(c("n") / c("block") >= LEAST_BLOCKS).withColumn("slots", F.ceil(c("n") / c("block"))))
    sums = settled(carried(rows, "sum", {f"upto_{v}": c(v) for v in values}, keys).select(*keys, "pos", *values, *[f"upto_{v}" for v in values]))
    low = sums.join(able, keys).where(c("pos") <= c("n") - c("block")).withColumn("whole_end", c("pos") + c("block") - 1)
    low = low.withColumn("short_end", c("pos") + c("n") - (c("slots") - 1) * c("block") - 1)
    for name in ("whole", "short"):
        low = low.join(sums.select(*keys, c("pos").alias(f"{name}_end"), *[c(f"upto_{v}").alias(f"{name}_{v}") for v in values]), [*keys, f"{name}_end"])
    starts = low.select(*keys, c("pos").alias("start"), *[(c(f"{name}_{v}") - c(f"upto_{v}") + c(v)).alias(f"{name}_{v}") for name in ("whole", "short") for v in values])
    # The few rows of `able` would leave all draws to one task, so the resamples are dealt out before their slots are made.
    draws = dealt(able.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))), *keys, "b").withColumn("slot", F.explode(F.sequence(F.lit(0), (c("slots") - 1).cast("int"))))
    name = F.concat_ws("|", *[c(k).cast("string") for k in keys], c("b").cast("string"), c("slot").cast("string"))
    draws = draws.withColumn("start", F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), c("n") - c("block") + 1))
    size = (able.agg(F.sum(c("n") - c("block") + 1)).first()[0] or 0) * (len(keys) + 1 + 2 * len(values))
    # Beside sums that fit in memory no draw moves, and a resample is added up where it was dealt to.
    met = draws.join(F.broadcast(starts) if size <= LOOKUP_VALUES else starts.hint("shuffle_hash"), [*keys, "start"])
    return met.groupBy(*keys, "b", "n").agg(*[F.sum(F.when(c("slot") == c("slots") - 1, c(f"short_{v}")).otherwise(c(f"whole_{v}"))).alias(v) for v in values])


def tail_p(estimates: DataFrame, keys: list[str], reference: float) -> DataFrame:
    """(keys, p_value): two-sided, from the smaller tail of the resampled estimates m."""
    out = estimates.groupBy(*keys).agg(F.least(F.count_if(c("m") <= reference), F.count_if(c("m") >= reference)).alias("k"), F.count(F.lit(1)).alias("draws"))
    return out.select(*keys, F.least(F.lit(1.0), 2 * (c("k") + 1) / (c("draws") + 1)).alias("p_value"))


def interval(points: DataFrame, estimates: DataFrame, keys: list[str], reference: float = CHANCE) -> DataFrame:
    """points (keys, n, value) with low, high (2.5 and 97.5 percentiles of the estimates m), p_value and resamples.

    Bounds and p are refused (null) for series without estimates and where the interval misses the value.
    """
    estimates = settled(estimates.select(*keys, "m"))
    q = estimates.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("resamples"))
    out = points.join(q.join(tail_p(estimates, keys, reference), keys), keys, "left")
    low, high = F.element_at("q", 1), F.element_at("q", 2)
    kept = c("value").between(low, high)
    return out.select(*points.columns, *[F.when(kept, x).alias(name) for x, name in ((low, "low"), (high, "high"), (c("p_value"), "p_value"))], "resamples")


def mean_interval(rows: DataFrame, resamples: int = RESAMPLES, reference: float = CHANCE, keys: list[str] = SERIES) -> DataFrame:
    """The mean of x with its interval and p."""
    points = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("value"))
    means = resampled(rows, keys, ["x"], resamples).withColumn("m", c("x") / c("n"))
    return interval(points, means, keys, reference)


def calibration_error_interval(quality: DataFrame, keys: list[str] = SERIES, bins: int = 10, resamples: int = RESAMPLES) -> DataFrame:
    """The expected calibration error with its interval, found anew in every resample.

    A bin's share of the error is the absolute sum of hit less confidence over it, so sums by bin are all that a resample needs.
    """
    rows = quality.where("status = 'scored'").withColumns({"gap": c("correct").cast("double") - c("confidence"), "bin": F.least(F.lit(bins - 1), F.floor(c("confidence") * bins))})
    rows = numbered(settled(rows.select(*keys, "forward", "idx", *[F.when(c("bin") == k, c("gap")).otherwise(0.0).alias(f"gap_{k}") for k in range(bins)])), keys)
    names = [f"gap_{k}" for k in range(bins)]
    total = lambda of: sum((F.abs(of(x)) for x in names[1:]), F.abs(of(names[0])))
    points = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (total(F.sum) / F.count(F.lit(1))).alias("value"))
    return interval(points, resampled(rows, keys, names, resamples).withColumn("m", total(c) / c("n")), keys).drop("p_value")


def statistic_interval(rows: DataFrame, keys: list[str], partials: dict[str, Column], finish: Callable[[Callable[[str], Column], Column], Column], resamples: int = RESAMPLES, reference: float = CHANCE) -> DataFrame:
    """Any statistic of rows (keys, forward, idx) that `finish` makes of sums of partials and the number of rows, with its interval and p.

    finish takes a function from a partial's name to its sum, and the number; a ratio of means, a moment or a quantile from a histogram
    (`median_of`) are of this kind. Every resample sums the partials of its blocks, so it costs what a mean costs.
    """
    names, total = {k: f"__p_{k}" for k in partials}, lambda k: c(f"__p_{k}")
    rows = numbered(settled(rows.select(*keys, "forward", "idx", *[p.cast("double").alias(names[k]) for k, p in partials.items()])), keys)
    points = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in names.values()]).select(*keys, "n", finish(total, c("n")).alias("value"))
    return interval(points, resampled(rows, keys, list(names.values()), resamples).withColumn("m", finish(total, c("n"))), keys, reference)


def median_of(x: Column, edges: list[float]) -> tuple[dict[str, Column], Callable[[Callable[[str], Column], Column], Column]]:
    """Partials and finish of the median of x, read from its histogram over edges by interpolation; values from the last edge on count as that edge."""
    inside = [(x >= a) & (x < b) for a, b in zip(edges, edges[1:], strict=False)] + [x >= edges[-1]]
    partials = {f"bin_{k}": F.coalesce(hit.cast("double"), F.lit(0.0)) for k, hit in enumerate(inside)}

    def finish(total: Callable[[str], Column], n: Column) -> Column:
        half, before, out = n / 2, F.lit(0.0), None
        for k, (a, b) in enumerate(zip(edges, [*edges[1:], edges[-1]], strict=True)):
            here = total(f"bin_{k}")
            value = F.lit(float(a)) + F.try_divide(half - before, here) * (b - a)
            out = F.when(before + here >= half, value) if out is None else out.when(before + here >= half, value)
            before = before + here
        return out

    return partials, finish


def versus(low: Column, high: Column, reference: float) -> Column:
    return F.when(low.isNull(), None).when(low > reference, "above").when(high < reference, "below").otherwise("indistinguishable")


def benjamini_hochberg(rows: DataFrame, keys: list[str] = SERIES, within: list[str] | None = None) -> DataFrame:
    """q-values of the rows that have a p-value, over all rows or within groups; one row a test, so a group's tests are ranked in one task."""
    some, group = rows.where("p_value is not null"), within or []
    m = F.count(F.lit(1)).over(Window.partitionBy(*group))
    ranked = some.withColumn("raw", c("p_value") * m / F.row_number().over(Window.partitionBy(*group).orderBy("p_value", *keys)))
    down = Window.partitionBy(*group).orderBy(c("p_value").desc(), *[c(k).desc() for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q_value", F.least(F.lit(1.0), F.min("raw").over(down))).drop("raw")


def departures(rows: DataFrame, keys: list[str], draws: int = P_RESAMPLES, precise: int = PRECISE_RESAMPLES) -> DataFrame:
    """Every estimable series of hits (keys, forward, pos, x) against chance, with q-values over all of them.

    Survivors of the correction are drawn again with `precise` draws, and with blocks twice as long.
    """
    means = lambda of, n, stretch=1: resampled(of, keys, ["x"], n, stretch).withColumn("m", c("x") / c("n"))
    points = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("value"))
    bounds = interval(points, means(rows, RESAMPLES), keys).where("low is not null").drop("p_value", "resamples")
    tested = settled(benjamini_hochberg(bounds.join(tail_p(means(rows, draws), keys, CHANCE), keys), keys))
    again = rows.join(tested.where(c("q_value") < DISCOVERIES).select(*keys), keys, "left_semi")
    out = tested.join(tail_p(means(again, precise), keys, CHANCE).withColumnRenamed("p_value", "p_precise"), keys, "left")
    out = out.join(tail_p(means(again, draws, 2), keys, CHANCE).withColumnRenamed("p_value", "p_double_block"), keys, "left")
    ranked = benjamini_hochberg(out.select(*keys, F.coalesce("p_precise", "p_value").alias("p_value")), keys).select(*keys, c("q_value").alias("q_precise"))
    return out.join(ranked, keys).withColumn("q_precise", F.when(c("p_precise").isNotNull(), c("q_precise")))


def paired(quality: DataFrame) -> DataFrame:
    """Differences of hits and log losses of two models on the same bar and horizon."""
    ok = quality.where("status = 'scored'").select("symbol", "horizon", "forward", "open_time", "model", c("correct").cast("long").alias("hit"), "nll")
    other = ok.select("symbol", "horizon", "open_time", c("model").alias("m2"), c("hit").alias("hit2"), c("nll").alias("nll2"))
    met = ok.join(other, ["symbol", "horizon", "open_time"]).where("model < m2")
    return met.select("symbol", "horizon", "forward", "open_time", c("model").alias("m1"), "m2", (c("hit") - c("hit2")).alias("hit"), (c("nll") - c("nll2")).alias("loss"))


def standing_in(quality: DataFrame, seeds: list[int]) -> DataFrame:
    """Rows of runs (model, seed) for every one of the seeds; a model of one run stands in for each seed."""
    single = quality.select("symbol", "model", "seed").distinct().groupBy("symbol", "model").agg(F.count(F.lit(1)).alias("runs")).where("runs = 1").select("symbol", "model", F.lit(True).alias("single"))
    rows = quality.join(single, ["symbol", "model"], "left")
    each = F.when(c("single"), F.array(*map(F.lit, seeds))).otherwise(F.array("seed"))
    return rows.withColumn("seed", F.explode(each)).drop("single")


def paired_differences(quality: DataFrame, seeds: list[int], resamples: int = RESAMPLES) -> DataFrame:
    """Mean differences of hits and of log losses for each pair of models and horizon, over the panel of dates and (symbol, seed) cells.

    Whole dates are drawn, so that what moves all symbols stays in the interval; the panel's mean is a ratio of sums by date.
    """
    ok = standing_in(quality.where("status = 'scored'"), seeds).withColumn("date", F.to_date("open_time"))
    ok = ok.select("symbol", "seed", "horizon", "forward", "date", "model", c("correct").cast("double").alias("hit"), "nll")
    other = ok.select("symbol", "seed", "horizon", "date", c("model").alias("second"), c("hit").alias("hit2"), c("nll").alias("nll2"))
    met = ok.withColumnRenamed("model", "first").join(other, ["symbol", "seed", "horizon", "date"]).where("first < second")
    keys = ["horizon", "first", "second"]
    days = met.groupBy(*keys, "forward", "date").agg(F.sum(c("hit") - c("hit2")).alias("accuracy"), F.sum(c("nll") - c("nll2")).alias("log_loss"), F.count(F.lit(1)).cast("double").alias("cells"))
    days = numbered(settled(days.withColumn("day", F.unix_date("date"))), keys, "day")
    drawn = resampled(days, keys, ["accuracy", "log_loss", "cells"], resamples)
    panel = met.groupBy(*keys).agg(F.count_distinct("symbol", "seed").alias("panel_cells"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), c(m).alias("total")) for m in ("accuracy", "log_loss")])).alias("x")
    points = days.groupBy(*keys).agg(F.sum("accuracy").alias("accuracy"), F.sum("log_loss").alias("log_loss"), F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("n"))
    points = points.select(*keys, "n", "cells", each).select(*keys, c("x.measure").alias("measure"), "n", (c("x.total") / c("cells")).alias("value"))
    estimates = drawn.select(*keys, "cells", each).select(*keys, c("x.measure").alias("measure"), (c("x.total") / c("cells")).alias("m"))
    out = interval(points, estimates, [*keys, "measure"], 0.0).join(panel, keys)
    q = benjamini_hochberg(out, keys, ["measure"]).select(*keys, "measure", "q_value")
    return out.join(q, [*keys, "measure"], "left")


def boot_sql(source: str, name: str, keys: str, values: str, point: str, estimate: str, reference: float = CHANCE, resamples: int = RESAMPLES, stretch: int = 1) -> str:
    """SQL of `interval` over `resampled`: relations from source (keys, forward, pos, values); estimate is over sums S(v)."""
    ks = [k.strip() for k in keys.split(",")]
    vs = [v.strip() for v in values.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    for v in vs:
        estimate = estimate.replace(f"S({v})", f"sum(h.upto_{v} - l.upto_{v} + l.{v})")
    return f"""
{name}_s AS (SELECT {keys}, pos, {values}, {', '.join(f'sum({v}) OVER (PARTITION BY {keys} ORDER BY pos) AS upto_{v}' for v in vs)} FROM {source}),
{name}_b AS (SELECT {keys}, max(forward) * {stretch} AS block, count(*) AS n, {point} AS value FROM {source} GROUP BY {keys}),
{name}_d AS (SELECT *, unnest(range(ceil(n / block)::bigint)) AS slot FROM (SELECT *, unnest(range({resamples})) AS b FROM {name}_b WHERE n / block >= {LEAST_BLOCKS})),
{name}_t AS (SELECT *, ('0x' || substr(md5({" || '|' || ".join([*ks, 'b', 'slot'])}), 1, 8))::bigint % (n - block + 1) AS start, least(block, n - slot * block) AS size FROM {name}_d),
{name}_e AS (SELECT {', '.join(f't.{k} AS {k}' for k in ks)}, b, {estimate} AS m FROM {name}_t t JOIN {name}_s h ON {on('t', 'h')} AND h.pos = t.start + t.size - 1 JOIN {name}_s l ON {on('t', 'l')} AND l.pos = t.start GROUP BY {', '.join(f't.{k}' for k in ks)}, b),
{name}_q AS (SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, least(1.0, 2.0 * (least(count_if(m <= {reference}), count_if(m >= {reference})) + 1) / (count(*) + 1)) AS p, count(*) AS resamples FROM {name}_e GROUP BY {keys}),
{name} AS (SELECT {', '.join(f'b.{k} AS {k}' for k in ks)}, n, value, CASE WHEN value BETWEEN lo AND hi THEN lo END AS low, CASE WHEN value BETWEEN lo AND hi THEN hi END AS high, CASE WHEN value BETWEEN lo AND hi THEN p END AS p_value, resamples
  FROM {name}_b b LEFT JOIN {name}_q q ON {on('b', 'q')})"""


def bh_sql(source: str, name: str, keys: str, within: str = "") -> str:
    """SQL of `benjamini_hochberg`."""
    group, down = (f"PARTITION BY {within}" if within else ""), ", ".join(f"{k.strip()} DESC" for k in keys.split(","))
    return f"""
{name}_0 AS (SELECT *, p_value * count(*) OVER ({group}) / row_number() OVER ({group} ORDER BY p_value, {keys}) AS raw FROM {source} WHERE p_value IS NOT NULL),
{name} AS (SELECT *, least(1.0, min(raw) OVER ({group} ORDER BY p_value DESC, {down} ROWS UNBOUNDED PRECEDING)) AS q_value FROM {name}_0)"""
