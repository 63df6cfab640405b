"""Temperatures: fitted on a grid, carried to windows without one, and applied to forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain as d

c = F.col


def _tried(rows: DataFrame, keys: list[str], temperatures: tuple[float, ...]) -> DataFrame:
    """(keys, ord, t, nll, n, kinds): mean log loss of rows (keys, p_long, is_long) at each temperature."""
    grid = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(t).alias("t")) for k, t in enumerate(temperatures)])
    p = F.when(c("is_long"), c("p_long")).otherwise(1 - c("p_long"))
    rows = rows.select(*keys, "is_long", p.alias("p"), F.explode(grid).alias("g")).select(*keys, "is_long", "p", "g.*")
    up, down = (F.pow(F.greatest(x, F.lit(1e-12)), 1 / c("t")) for x in (c("p"), 1 - c("p")))
    return rows.groupBy(*keys, "ord", "t").agg(F.avg(d.nll(up / (up + down))).alias("nll"), F.count(F.lit(1)).alias("n"), F.count_distinct("is_long").alias("kinds"))


def fit_temperature(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, temperature, fitted_on, nll): the temperature of the fixed grid with the least mean log loss, the first of equals.

    Fewer than LEAST_FITTED rows, or rows of one direction alone, fit nothing: temperature 1, fitted_on 0.
    """
    best = F.min(F.struct(F.round("nll", 9).alias("a"), "ord", "t", "nll")).alias("best")
    plain = F.max(F.when(c("t") == 1.0, c("nll"))).alias("plain")
    out = _tried(rows, keys, d.TEMPERATURES).groupBy(*keys).agg(best, plain, F.max("n").alias("n"), F.max("kinds").alias("kinds"))
    able = (c("n") >= d.LEAST_FITTED) & (c("kinds") > 1)
    return out.select(*keys, F.when(able, c("best.t")).otherwise(1.0).alias("temperature"), F.when(able, c("n")).otherwise(F.lit(0).cast("long")).alias("fitted_on"), F.when(able, c("best.nll")).otherwise(c("plain")).alias("nll"))


def calibrated_nll(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, nll): the least mean log loss over the grid; the plain one for rows of one direction. Keys without rows have no loss."""
    out = _tried(rows, keys, d.TEMPERATURES).groupBy(*keys).agg(F.max("n").alias("n"), F.when(F.max("kinds") > 1, F.min("nll")).otherwise(F.max(F.when(c("t") == 1.0, c("nll")))).alias("nll"))
    return out


def temperature_memory(fits: DataFrame, keys: list[str], window: str) -> DataFrame:
    """fits (keys, window, temperature, fitted_on) with the temperature in use and its source.

    A window without a fit takes the last one fitted before it for the same keys, and before the first the top of the grid. One
    row a window, so a key's windows are looked through in one task.
    """
    earlier = Window.partitionBy(*keys).orderBy(window).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(c("fitted_on") > 0, c("temperature"))
    rows = fits.withColumn("carried", F.last(own, ignorenulls=True).over(earlier))
    used = F.coalesce(own, c("carried"), F.lit(d.TEMPERATURES[-1]))
    return rows.withColumns({"source": d.fitted_temperature_source(own, c("carried")), "temperature": used}).drop("carried")


def tempered_long(p_long: Column, t: Column) -> Column:
    """P_long after a temperature; 0.5 where the probabilities are none."""
    pair = d.normalized(F.array(p_long, 1 - p_long), 2)
    return F.when(F.abs(t - 1) < 1e-9, pair[0]).otherwise(d.tempered(pair, t)[0])


def calibrate(forecasts: DataFrame, memory: DataFrame, on: list[str]) -> DataFrame:
    """forecasts with the probabilities after their window's temperature, and the raw ones, temperature, source and rows beside."""
    rows = forecasts.join(memory.select(*on, "temperature", "source", "fitted_on"), on)
    rows = rows.withColumns({"raw_long": c("p_long"), "raw_short": c("p_short")})
    rows = rows.withColumn("p_long", tempered_long(c("raw_long"), c("temperature")))
    return rows.withColumns({"p_short": 1 - c("p_long"), "calibration": F.struct("temperature", "source", c("fitted_on").alias("calibrated_on"), c("raw_long").alias("uncalibrated_long"), c("raw_short").alias("uncalibrated_short"))})


def temperature_facts(calibrated: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: the median fitted temperature, the share of fitted ones above 10, mean absolute edges before and after, the share without a fit of their own."""
    own = F.when(c("source") == "fitted", c("temperature"))
    return calibrated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("forecasts"), F.percentile(own, 0.5).alias("median_temperature"), F.avg(F.when(own.isNotNull(), (own > 10).cast("double"))).alias("above_ten"),
        F.avg(F.abs(c("raw_long") - c("raw_short"))).alias("edge_raw"), F.avg(F.abs(c("p_long") - c("p_short"))).alias("edge_calibrated"), F.avg((c("source") != "fitted").cast("double")).alias("without_slice"),
    )
