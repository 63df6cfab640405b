"""Candle files, their manifests, and stored forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rollups import normalize_time

c = F.col
_REST = {"close_time": (6, "bigint"), "quote_asset_volume": (7, "double"), "num_trades": (8, "bigint"), "taker_buy_base_volume": (9, "double"), "taker_buy_quote_volume": (10, "double")}


def ingest(spark: SparkSession, path: str, interval: str) -> DataFrame:
    """Bars from headerless CSV files named SYMBOL-... or in folders symbol=...: rows of fewer than six fields or without numbers are skipped, later fields are optional."""
    rows = spark.read.text(path)
    if "symbol" not in rows.columns:
        rows = rows.select("value", F.regexp_extract(F.input_file_name(), "([^/]+?)[-_.][^/]*$", 1).alias("symbol"))
    return parsed(rows, interval)


def parsed(rows: DataFrame, interval: str) -> DataFrame:
    """Bars from lines (symbol, value)."""
    f = F.split("value", ",")
    number = lambda k, kind: F.try_element_at(f, F.lit(k + 1)).try_cast(kind)
    first = {name: number(k + 1, "double") for k, name in enumerate(("open", "high", "low", "close", "volume"))}
    rows = rows.where(F.size(f) >= 6).select("symbol", F.lit(interval).alias("interval"), number(0, "bigint").alias("__t"), *[v.alias(k) for k, v in first.items()], *[number(k, t).alias(n) for n, (k, t) in _REST.items()])
    rows = rows.dropna(subset=["__t", *first]).withColumn("open_time", normalize_time(c("__t"))).drop("__t")
    return rows.withColumn("close_time", normalize_time(c("close_time")))


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """name, ok: whether each file's SHA-256 is the first word of its .CHECKSUM file; a missing one counts as failed."""
    names = F.regexp_extract("path", "([^/]+)$", 1)
    files = spark.read.format("binaryFile").load(folder).select(names.alias("name"), F.sha2("content", 256).alias("digest"), F.split(c("content").cast("string"), r"\s+")[0].alias("word"))
    manifests = files.where(c("name").endswith(".CHECKSUM")).select(F.regexp_replace("name", r"\.CHECKSUM$", "").alias("name"), F.lower("word").alias("want"))
    return files.where(~c("name").endswith(".CHECKSUM")).join(manifests, "name", "left").select("name", F.coalesce(c("digest") == c("want"), F.lit(False)).alias("ok"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """name (the path below the folder), digest of every file in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    last = folder.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.element_at(F.split("path", f"/{last}/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))


def verify_lines(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """name, ok: whether each file's SHA-256 is the first word of the line (digest, name) that a manifest has for it."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(manifest).where(F.size(f) >= 2).select(F.lower(f[0]).alias("want"), f[1].alias("name"))
    return digests(spark, folder).join(lines, "name", "left").select("name", F.coalesce(c("digest") == c("want"), F.lit(False)).alias("ok"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Month partitions, each written by one task; only those that bars touches are replaced."""
    rows = bars.withColumns({"year": F.year("open_time"), "month": F.month("open_time")}).repartition("interval", "symbol", "year", "month")
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("interval", "symbol", "year", "month").parquet(path)


def write_weeks(bars: DataFrame, path: str) -> None:
    """Weekly bars by ISO year and week, the partitions of which are replaced."""
    rows = bars.withColumns({"year": F.expr("extract(YEAROFWEEK FROM open_time)"), "week": F.weekofyear("open_time")}).repartition("interval", "symbol", "year")
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("interval", "symbol", "year", "week").parquet(path)


def files(spark: SparkSession, path: str, suffix: str = ".parquet") -> DataFrame:
    """Every file below a path: path, bytes, and the values of `symbol`, `interval`, `year`, `month`, `week` and `horizon` in its folders' names.

    Only the listing is read, no file's content.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("path", c("length").alias("bytes"))
    named = lambda k: F.nullif(F.regexp_extract("path", f"/{k}=([^/]+)/", 1), F.lit("")).alias(k)
    return rows.select("path", "bytes", *map(named, ("symbol", "interval", "horizon")), *[named(k).try_cast("int").alias(k) for k in ("year", "month", "week")])


def read_bars(spark: SparkSession, path: str, first_month: str | None = None, last_month: str | None = None) -> DataFrame:
    """Bars between two months (YYYY-MM), by partitions."""
    rows = spark.read.parquet(path)
    at = c("year") * 100 + c("month")
    for bound, rule in ((first_month, at.__ge__), (last_month, at.__le__)):
        if bound:
            rows = rows.where(rule(int(bound.replace("-", ""))))
    return rows


def write_forecasts(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("model", "interval", "run_ts").mode("append").parquet(path)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Stored forecasts; the names of runs stay text, which Spark would read as numbers where they look like some (an interval of 1d as 1.0)."""
    schema = spark.read.parquet(path).schema
    for name in ("model", "interval", "run_ts"):
        schema[name].dataType = T.StringType()
    return spark.read.schema(schema).parquet(path)


def read_prediction_lines(spark: SparkSession, path: str, horizons: list[str], strict: bool = False) -> DataFrame:
    """Forecasts from JSON lines with an object for each horizon, one row a horizon; malformed lines are skipped or refused."""
    payload = "struct<P_long:double,P_short:double,trained:boolean,depth_long_bins:map<string,double>,depth_short_bins:map<string,double>>"
    schema = "open_time string, date string, symbol string, " + ", ".join(f"`{h}` {payload}" for h in horizons)
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), c(h).alias("p")) for h in horizons]))
    out = rows.select(F.to_timestamp("open_time").alias("open_time"), "date", "symbol", each.alias("h")).where("h.p is not null")
    return out.select("open_time", "date", "symbol", "h.horizon", c("h.p.P_long").alias("p_long"), c("h.p.P_short").alias("p_short"), F.coalesce("h.p.trained", F.lit(True)).alias("trained"), c("h.p.depth_long_bins").alias("up"), c("h.p.depth_short_bins").alias("down"))


def write_prediction_lines(rows: DataFrame, path: str, horizons: list[str], labels: list[str]) -> None:
    """Forecasts as JSON lines, one a bar, with an object for each horizon; depth arrays become maps by bin name."""
    bins = lambda x: F.map_from_arrays(F.array(*map(F.lit, labels)), c(x))
    payload = F.struct(c("p_long").alias("P_long"), c("p_short").alias("P_short"), "trained", bins("up").alias("depth_long_bins"), bins("down").alias("depth_short_bins"))
    lines = rows.groupBy("symbol", "open_time").agg(*[F.first(F.when(c("horizon") == h, payload), ignorenulls=True).alias(h) for h in horizons])
    lines = lines.select(F.date_format("open_time", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("open_time"), F.date_format("open_time", "yyyy-MM-dd").alias("date"), "symbol", *horizons)
    lines.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


# The order of the columns of a quality table.
QUALITY = ("symbol", "model", "interval", "open_time", "horizon", "forward", "status", "target_time", "predicted", "confidence", "p_short", "p_long", "predicted_depth", "predicted_bin", "direction", "fwd_return", "depth_bin", "correct", "brier", "nll", "entropy", "depth_kl", "depth_js", "depth_abs_error_pct", "quality_score", "error_score", "flags", "reason")


def write_quality(rows: DataFrame, path: str) -> None:
    """A quality table as zstd Parquet: the fixed columns that rows has in their order, then the others by name; flags joined by |."""
    named = [x for x in QUALITY if x in rows.columns]
    rows = rows.withColumn("flags", F.array_join("flags", "|")) if "flags" in rows.columns else rows
    rows.select(*named, *sorted(set(rows.columns) - set(named))).write.option("compression", "zstd").parquet(path)


def write_worst(rows: DataFrame, path: str, limit: int = 100) -> None:
    """The worst scored rows as CSV with a header."""
    fields = ["open_time", "horizon", "target_time", "direction", "predicted", "confidence", "quality_score", "error_score", "flags", "reason"]
    worst = rows.where("status = 'scored'").orderBy(c("error_score").desc(), "open_time", "horizon", "symbol").limit(limit)
    worst.select("symbol", *[F.array_join(x, "|").alias(x) if x == "flags" else c(x) for x in fields]).write.option("header", True).csv(path)


def spot_symbols(spark: SparkSession, path: str, quote: str) -> DataFrame:
    """Trading spot symbols of a quote asset from an exchange-info document."""
    schema = "symbols array<struct<symbol:string,status:string,quoteAsset:string,permissions:array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("symbols").alias("s")).select("s.*")
    spot = c("permissions").isNull() | F.array_contains("permissions", "SPOT")
    return rows.where((c("status") == "TRADING") & spot & (c("symbol").endswith(quote) | (c("quoteAsset") == quote))).select("symbol").distinct()
