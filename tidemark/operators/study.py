"""Comparisons over several runs: one row a (symbol, model, seed, horizon) in, facts about models and horizons out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain as d
from . import significance

c = F.col
RUN = ["symbol", "model", "seed", "horizon"]
#: The model that learns nothing, left out of comparisons of learners.
UNLEARNED = "baseline"
EDGES, LEAST_IN_BIN = (0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 0.9, 1.0001), 200


def cells(quality: DataFrame) -> DataFrame:
    ok = quality.where("status = 'scored'")
    return ok.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.avg(c("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"), F.avg("brier").alias("brier"), F.avg("nll").alias("nll"))


def seed_invariant(cells: DataFrame, places: int = 9) -> DataFrame:
    """(symbol, model, first): cells of several runs that scored alike under every seed, with their first seed."""
    text = lambda x: F.round(c(x), places).cast("decimal(18,9)").cast("string")
    key = F.concat_ws("|", "horizon", c("n").cast("string"), *map(text, ("accuracy", "confidence", "brier", "nll")))
    runs = cells.groupBy("symbol", "model", "seed").agg(F.md5(F.array_join(F.array_sort(F.collect_list(key)), ";")).alias("key"))
    return runs.groupBy("symbol", "model").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("key").alias("kinds"), F.min("seed").alias("first")).where("runs > 1 and kinds = 1").select("symbol", "model", "first")


def distinct_runs(rows: DataFrame, invariant: DataFrame) -> DataFrame:
    """rows without the repeated runs of cells that no seed changes."""
    return rows.join(invariant, ["symbol", "model"], "left").where(c("first").isNull() | (c("seed") == c("first"))).drop("first")


def architecture_spread(cells: DataFrame) -> DataFrame:
    """Per horizon: ranges of the models' mean accuracies (all, and learners), and how far a run moves under another seed."""
    by = cells.groupBy("horizon", "model").agg(F.avg("accuracy").alias("mean"))
    learner = F.when(c("model") != UNLEARNED, c("mean"))
    several = lambda x: F.when(F.count(x) > 1, F.max(x) - F.min(x))
    out = by.groupBy("horizon").agg(F.count(F.lit(1)).alias("models"), several(c("mean")).alias("spread"), several(learner).alias("spread_learners"))
    moved = cells.join(seed_invariant(cells), ["symbol", "model"], "left_anti").groupBy("horizon", "symbol", "model").agg(F.stddev_samp("accuracy").alias("std"))
    return out.join(moved.groupBy("horizon").agg(F.avg("std").alias("noise")), "horizon", "left")


def places(cells: DataFrame) -> DataFrame:
    """horizon, model, place: learners in the order of their mean accuracy."""
    by = cells.where(c("model") != UNLEARNED).groupBy("horizon", "model").agg(F.avg("accuracy").alias("mean"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("horizon").orderBy(F.round("mean", 9).desc(), "model")).cast("long"))


def rank_agreement(cells: DataFrame) -> DataFrame:
    """One row: the mean correlation of the learners' places over pairs of horizons, and the number of pairs."""
    ranked = places(cells)
    other = ranked.select("model", c("horizon").alias("other"), c("place").alias("place2"))
    pairs = ranked.join(other, "model").where("horizon < other").groupBy("horizon", "other").agg(F.corr("place", "place2").alias("r"))
    return pairs.agg(F.count("r").alias("pairs"), F.avg("r").alias("correlation"))


def rank_places(cells: DataFrame) -> DataFrame:
    """Mean place of each learner over horizons, with its best and worst one."""
    return places(cells).groupBy("model").agg(F.avg("place").alias("mean_place"), F.min("place").alias("best"), F.max("place").alias("worst"))


def study_facts(cells: DataFrame, intervals: DataFrame) -> DataFrame:
    """Per horizon over distinct runs: least and most accuracy, runs with an interval, and those wholly above or below chance."""
    found = distinct_runs(cells, seed_invariant(cells)).join(intervals.select(*RUN, "low", "high"), RUN, "left")
    return found.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("runs"), F.min("accuracy").alias("least"), F.max("accuracy").alias("most"), F.count("low").alias("estimable"),
        F.count_if(c("low") > significance.CHANCE).alias("above"), F.count_if(c("high") < significance.CHANCE).alias("below"),
    )


def best_cell(cells: DataFrame, intervals: DataFrame) -> DataFrame:
    """Per horizon the run with the highest accuracy, with its interval."""
    best = F.max(F.struct(F.round("accuracy", 9).alias("a"), "symbol", "model", "seed")).alias("b")
    out = cells.groupBy("horizon").agg(best).select("horizon", "b.symbol", "b.model", "b.seed", c("b.a").alias("accuracy"))
    return out.join(intervals.select(*RUN, "low", "high"), RUN, "left")


def calibration_facts(cells: DataFrame, ece: DataFrame, windows: DataFrame) -> DataFrame:
    """Per model and horizon: mean ECE, confidence and hit rate, the median window, and the independent observations of the held-out slice."""
    met = cells.join(ece, RUN).groupBy("model", "horizon").agg(F.avg("ece").alias("ece"), F.avg("confidence").alias("confidence"), F.avg("accuracy").alias("hit_rate"))
    width = windows.groupBy("horizon", "forward").agg(F.percentile("steps", 0.5).alias("window"))
    return met.join(width, "horizon").withColumn("slice_observations", d.HELD_OUT * (c("window") - c("forward")) / c("forward")).drop("forward")


def reliability(quality: DataFrame, keys: list[str]) -> DataFrame:
    """Declared confidence against hit rate in bins of uneven width; bins of too few forecasts are left out."""
    edges = F.array(*map(F.lit, EDGES))
    rows = quality.where("status = 'scored'").withColumn("bin", F.size(F.filter(edges, lambda e: e <= c("confidence"))) - 1).where((c("bin") >= 0) & (c("bin") < len(EDGES) - 1))
    out = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(c("correct").cast("double")).alias("accuracy"))
    return out.where(c("n") >= LEAST_IN_BIN).withColumns({"low": F.element_at(edges, c("bin") + 1), "high": F.element_at(edges, c("bin") + 2)}).drop("bin")


def batch_status(quality: DataFrame, keys: list[str], least_score: float = 50.0) -> DataFrame:
    """Each run's status, score and alert: evaluated where it has a scored row, else failed with the reason."""
    ok = c("status") == "scored"
    by = quality.groupBy(*keys, "horizon").agg(F.count_if(ok).alias("samples"), F.avg(F.when(ok, c("quality_score"))).alias("score"), F.count(F.lit(1)).alias("rows"))
    out = by.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("samples").alias("samples"), F.try_divide(F.sum(c("samples") * c("score")), F.sum("samples")).alias("model_score"))
    status = F.when(c("samples") > 0, "ok").otherwise("failed")
    return out.withColumns({"status": status, "error": F.when(c("samples") == 0, "no scored row"), "alert": F.coalesce(c("model_score") < least_score, F.lit(False))})


def failures(log: DataFrame, kept: int = 5) -> DataFrame:
    """Failed refits (run, stage, horizon, window, error) by run: how many, by horizon, by stage, and the first messages."""
    counts = lambda k: log.groupBy("run", k).agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(F.array_sort(F.collect_list(F.struct(k, "n"))).alias(f"by_{k}"))
    ranked = log.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("window", "horizon", "stage"))).where(c("k") <= kept)
    first = ranked.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "stage", "horizon", "window", "error").alias("m")))), lambda x: x.m).alias("first"))
    return log.groupBy("run").agg(F.count(F.lit(1)).alias("failed")).join(counts("horizon"), "run").join(counts("stage"), "run").join(first, "run")
