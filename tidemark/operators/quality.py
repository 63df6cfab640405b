"""Checks of bars: repeated times, broken prices, gaps, order; the inventory and what to repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .series import KEYS, beside, indexed

c = F.col


def duplicates(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEYS, "open_time").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def violations() -> Column:
    """The rules of prices that a bar breaks."""
    return F.array_compact(F.array(
        F.when(F.least("open", "high", "low", "close", "volume") < 0, F.lit("negative")), F.when(c("high") < F.greatest("open", "close"), F.lit("high_below_body")), F.when(c("low") > F.least("open", "close"), F.lit("low_above_body")),
    ))


def ohlc_violations(bars: DataFrame) -> DataFrame:
    return bars.select(*KEYS, "open_time", F.explode(violations()).alias("kind"))


def gaps(bars: DataFrame, over_seconds: int) -> DataFrame:
    rows = beside(indexed(bars.select(*KEYS, "open_time")), {"since": lambda w: F.lag("open_time").over(w)}, KEYS, "idx", back=1)
    rows = rows.select(*KEYS, c("open_time").alias("until"), "since")
    return rows.withColumn("seconds", F.unix_seconds("until") - F.unix_seconds("since")).where(c("seconds") > over_seconds)


def preview(found: DataFrame, n: int) -> DataFrame:
    return found.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("until"))).where(c("k") <= n)


#: Rows of a file that are looked at together.
FILE_ROWS = 1 << 16


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """Bars of Parquet files with the order in which they were written: `__file` and `__row`."""
    rows = spark.read.parquet(path)
    return rows.select(*rows.columns, c("_metadata.file_path").alias("__file"), c("_metadata.row_index").alias("__row"))


def steps_back(bars: DataFrame) -> DataFrame:
    """keys, open_time of the bars of `ingested` rows that stand after a later one of their series: files in the order of their names.

    Neighbours are looked at inside parts of files; a part's first bar of a series is held to the last one of the parts before it.
    """
    place = [*KEYS, "__file", "__part"]
    rows = bars.select(*KEYS, "open_time", "__file", "__row", F.floor(c("__row") / FILE_ROWS).alias("__part"))
    rows = rows.withColumn("__last", F.lag("open_time").over(Window.partitionBy(*place).orderBy("__row")))
    parts = rows.groupBy(*place).agg(F.min_by("open_time", "__row").alias("open_time"), F.max_by("open_time", "__row").alias("__end"))
    across = parts.withColumn("__last", F.lag("__end").over(Window.partitionBy(*KEYS).orderBy("__file", "__part")))
    back = c("open_time") < c("__last")
    return rows.where(back).select(*KEYS, "open_time").unionByName(across.where(back).select(*KEYS, "open_time"))


def sortedness(bars: DataFrame) -> DataFrame:
    """By series of `ingested` rows: bars that stand after a later one, and whether there is none."""
    back = steps_back(bars).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("out_of_order"))
    return bars.select(*KEYS).distinct().join(back, KEYS, "left").fillna(0, ["out_of_order"]).withColumn("sorted", c("out_of_order") == 0)


def report(bars: DataFrame, over_seconds: int) -> DataFrame:
    """Rows, repeated rows, broken rules, gaps and, of `ingested` rows, bars out of order by month; all but the last two come from one pass over the bars."""
    month = lambda x: F.date_trunc("month", x).alias("month")
    at = bars.groupBy(*KEYS, "open_time").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.size(violations())).alias("broken"))
    rows = at.groupBy(*KEYS, month("open_time")).agg(F.sum("copies").alias("rows"), F.sum(F.when(c("copies") > 1, c("copies")).otherwise(0)).alias("duplicates"), F.sum("broken").alias("violations"))
    gap = gaps(bars, over_seconds).groupBy(*KEYS, month("until")).agg(F.count(F.lit(1)).alias("gaps"))
    out = rows.join(gap, [*KEYS, "month"], "left")
    if "__row" not in bars.columns:
        return out.fillna(0, ["gaps"]).withColumn("passed", c("duplicates") + c("violations") + c("gaps") == 0)
    out = out.join(steps_back(bars).groupBy(*KEYS, month("open_time")).agg(F.count(F.lit(1)).alias("out_of_order")), [*KEYS, "month"], "left").fillna(0, ["gaps", "out_of_order"])
    out = out.withColumn("sorted", c("out_of_order") == 0)
    return out.withColumn("passed", c("sorted") & (c("duplicates") + c("violations") + c("gaps") == 0))


def inventory(bars: DataFrame, step_seconds: int) -> DataFrame:
    out = bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("bars"), F.count_distinct(F.date_trunc("month", "open_time")).alias("months"), F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    found = gaps(bars, step_seconds).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("gaps"))
    out = out.join(found, KEYS, "left").fillna(0, ["gaps"])
    expected = (F.year("last") - F.year("first")) * 12 + F.month("last") - F.month("first") + 1
    out = out.withColumn("expected_months", expected.cast("long"))
    return out.withColumn("status", F.when(c("months") < c("expected_months"), "incomplete").when(c("gaps") > 0, "warning").otherwise("complete"))


def repair_plan(found: DataFrame) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(a).alias("action")) for k, a in ((1, "ingest"), (2, "rollup"), (3, "features"))])
    return found.where("status <> 'complete'").select(*KEYS, F.explode(steps).alias("s")).select(*KEYS, "s.*")
