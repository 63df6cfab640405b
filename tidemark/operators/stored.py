"""Stored forecasts scored against bars: each is matched to its bar by instant, else by date, and takes what came k bars on from that bar.

Outcomes of bars are kept as one row a symbol, day and horizon with the day's bars in order, so a match by instant and one by date are the
same lookup. Both sides can be kept as tables bucketed and sorted by that key: then neither is shuffled, however many runs are scored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain as d
from ..sources.tables import scratch

c = F.col
DAY = ["symbol", "day", "horizon"]


def days(labels: DataFrame) -> DataFrame:
    """symbol, day, horizon, bars: of `forecasts.labels` the day's bars in order, each with its outcome."""
    fields = ["open_time", "interval", "idx", "forward", "fwd_return", "direction", "depth_bin", "target_time"]
    return labels.groupBy("symbol", F.to_date("open_time").alias("day"), "horizon").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("bars"))


def by_day(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("day", F.to_date("open_time"))


def kept(rows: DataFrame, buckets: int) -> DataFrame:
    """rows (of `days` or `by_day`) as a table bucketed and sorted by symbol, day and horizon, in the shared folder."""
    spark, name = rows.sparkSession, f"kept_{uuid.uuid4().hex}"
    rows.repartition(buckets, *DAY).write.option("path", scratch(spark)).bucketBy(buckets, *DAY).sortBy(*DAY).saveAsTable(name)
    return spark.table(name)


def matched(forecasts: DataFrame, known: DataFrame) -> DataFrame:
    """forecasts with `at` (their own time) and, in place of it, the time, number and outcome of the bar at that instant, else of the first bar of that day.

    Forecasts of days without bars have nulls there.
    """
    met = forecasts.withColumnRenamed("open_time", "at").join(known, DAY, "left")
    bar = F.coalesce(F.get(F.filter("bars", lambda b: b["open_time"] == c("at")), F.lit(0)), F.get("bars", F.lit(0)))
    return met.withColumn("bar", bar).drop("bars", "day").select("*", "bar.*").drop("bar")


def scored_forms(forecasts: DataFrame) -> DataFrame:
    """Forecasts read from lines, with depth maps as arrays in the order of the bins; missing bins are 0, and what is left sums to 1."""
    names = F.array(*map(F.lit, d.DEPTH_BINS))
    bins = lambda m: d.normalized(F.transform(names, lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))), len(d.DEPTH_BINS))
    sides = d.normalized(F.array("p_long", "p_short"), 2)
    return forecasts.withColumns({"up": bins(c("up")), "down": bins(c("down")), "p_long": sides[0], "p_short": sides[1]})
