"""What a lake holds: months and weeks of bars, features and labels by symbol and interval, from the list of its files; what is missing and what repairs it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain as d
from ..sources.tables import settled
from .series import KEYS

c = F.col
WEEKLY = "1w"


def present(files: DataFrame) -> DataFrame:
    """symbol, interval, at (first day of a month, Monday of an ISO week), files, bytes of files that hold something (`candles.files`)."""
    week = F.date_add(F.trunc(F.make_date("year", F.lit(1), F.lit(4)), "week"), (c("week") - 1) * 7)
    rows = files.where("bytes > 0 AND symbol IS NOT NULL AND interval IS NOT NULL").withColumn("at", F.when(c("week").isNotNull(), week).otherwise(F.make_date("year", "month", F.lit(1))))
    return rows.where("at IS NOT NULL").groupBy(*KEYS, "at").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def missing_months(found: DataFrame, base: str = "1m") -> DataFrame:
    """symbol, interval, at: months of the base interval that another interval of the symbol lacks; a month of weeks is there when one of its ISO weeks is."""
    months = found.where(c("interval") == base).select("symbol", "at")
    wanted = found.where(c("interval") != base).select(*KEYS).distinct().join(months, "symbol")
    plain = wanted.where(c("interval") != WEEKLY).join(found.select(*KEYS, "at"), [*KEYS, "at"], "left_anti")
    weeks = found.where(c("interval") == WEEKLY).select("symbol", c("at").alias("week"))
    mondays = F.sequence(F.trunc("at", "week"), F.trunc(F.last_day("at"), "week"), F.expr("interval 7 days"))
    some = wanted.where(c("interval") == WEEKLY).withColumn("week", F.explode(mondays)).join(weeks, ["symbol", "week"]).select(*KEYS, "at").distinct()
    return plain.select(*KEYS, "at").unionByName(wanted.where(c("interval") == WEEKLY).select(*KEYS, "at").join(some, [*KEYS, "at"], "left_anti"))


def unsupported(asked: list[str]) -> list[str]:
    """Intervals that were asked for and that bars cannot be rolled up to."""
    return sorted(set(asked) - set(d.INTERVALS))


def intervals(bars: DataFrame, features: DataFrame, labels: DataFrame, base: str = "1m") -> DataFrame:
    """By symbol and interval of files of bars, features and labels: files, bytes, first, last, parts (months or weeks), gaps between them, months lacking
    against the base, whether features are there and labels of every horizon, status and reason.

    incomplete: no bars, gaps, or months that the base has; else warning: features or labels are missing; else complete.
    """
    bars, features, labels = (settled(x) for x in (bars, features, labels))  # listings: each is looked at several times
    found = present(bars)
    has = lambda files: files.where("bytes > 0").select(*KEYS).distinct()
    whole = labels.where("bytes > 0").groupBy(*KEYS).agg(F.count_distinct(F.when(c("horizon").isin(list(d.HORIZONS)), c("horizon"))).alias("kinds")).where(c("kinds") == len(d.HORIZONS)).select(*KEYS)
    facts = found.groupBy(*KEYS).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("parts"))
    due = F.when(c("interval") == WEEKLY, F.floor(F.datediff("last", "first") / 7)).otherwise((F.year("last") - F.year("first")) * 12 + F.month("last") - F.month("first")) + 1
    facts = facts.withColumn("gaps", F.greatest(F.lit(0), due - c("parts")).cast("long"))
    lacking = missing_months(found, base).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("lacking"))
    everything = has(bars).unionByName(has(features)).unionByName(labels.where("bytes > 0").select(*KEYS)).distinct()
    out = everything.join(facts, KEYS, "left").join(lacking, KEYS, "left").join(has(features).withColumn("features", F.lit(True)), KEYS, "left").join(whole.withColumn("labels", F.lit(True)), KEYS, "left")
    out = out.fillna(0, ["files", "bytes", "parts", "gaps", "lacking"]).fillna(False, ["features", "labels"])
    reason = F.when(c("parts") == 0, "no bars").when(c("gaps") > 0, F.concat(c("gaps").cast("string"), F.lit(" parts missing in between"))).when(c("lacking") > 0, F.concat(F.lit("behind the base by "), c("lacking").cast("string"), F.lit(" months")))
    reason = F.coalesce(reason, F.when(~c("features"), "no features").when(~c("labels"), "no labels of every horizon"))
    return out.withColumns({"status": F.when((c("parts") == 0) | (c("gaps") > 0) | (c("lacking") > 0), "incomplete").when(c("features") & c("labels"), "complete").otherwise("warning"), "reason": reason})


def symbols(found: DataFrame, failed: DataFrame | None = None, base: str = "1m") -> DataFrame:
    """By symbol: bytes of bars, first and last day of the base, its months and gaps, status, and the first of these reasons: intervals with gaps, behind the base,
    without bars, without features or labels; checks that failed (symbols of `failed`)."""
    some = lambda rule: F.array_sort(F.collect_set(F.when(rule, c("interval"))))
    mine = lambda x: F.max(F.when(c("interval") == base, c(x)))
    out = found.groupBy("symbol").agg(
        F.sum("bytes").alias("bytes"), mine("first").alias("first"), F.last_day(mine("last")).alias("last"), F.coalesce(mine("parts"), F.lit(0)).alias("months"), F.coalesce(mine("gaps"), F.lit(0)).alias("gaps"),
        some(c("gaps") > 0).alias("__gapped"), some((c("gaps") == 0) & (c("parts") > 0) & (c("lacking") > 0)).alias("__behind"), some(c("parts") == 0).alias("__empty"), some(c("status") == "warning").alias("__unmade"),
    )
    checked = failed.select("symbol").distinct().withColumn("__failed", F.lit(True)) if failed is not None else None
    out = out.join(checked, "symbol", "left") if checked is not None else out.withColumn("__failed", F.lit(None).cast("boolean"))
    named: list[tuple[Column, str, Column]] = [(F.size(x) > 0, text, x) for x, text in ((c("__gapped"), "gaps in "), (c("__behind"), "behind the base: "), (c("__empty"), "no bars of "), (c("__unmade"), "no features or labels of "))]
    reason = F.coalesce(*[F.when(rule, F.concat(F.lit(text), F.array_join(x, ", "))) for rule, text, x in named], F.when(c("__failed"), "checks failed"))
    status = F.when(named[0][0] | named[1][0] | named[2][0], "incomplete").when(reason.isNotNull(), "warning").otherwise("complete")
    return out.withColumns({"status": status, "reason": reason}).drop(*[x for x in out.columns if x.startswith("__")])


def repairs(found: DataFrame, base: str = "1m") -> DataFrame:
    """symbol, step, action, intervals, first, last: what mends each symbol that has bars of the base, in order.

    1 ingest where the base has gaps; 2 rollup of the other intervals that have gaps, lack months or hold nothing; 3 features and labels of those and of what lacks them.
    """
    ranges = found.where((c("interval") == base) & (c("parts") > 0)).select("symbol", "first", F.last_day("last").alias("last"))
    broken = (c("interval") != base) & (c("status") == "incomplete")
    rules = {(1, "ingest"): (c("interval") == base) & (c("gaps") > 0), (2, "rollup"): broken, (3, "features"): broken | (c("status") == "warning")}
    steps = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(k).alias("step"), F.lit(name).alias("action"))) for (k, name), rule in rules.items()]))
    rows = found.select("symbol", "interval", F.explode(steps).alias("s")).groupBy("symbol", "s.step", "s.action").agg(F.array_join(F.array_sort(F.collect_set("interval")), ", ").alias("intervals"))
    return rows.join(ranges, "symbol")
