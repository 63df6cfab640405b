"""Registered queries over files that Spark derives from the tables, and joins of bars with what was made from them."""

from __future__ import annotations

import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import domain as d
from ..operators import features, forecasts, inventory, rollups, series, stored
from ..sources import archives, candles
from ..sources.tables import BARS, daily_bars, scratch, settled, table, tick_bars
from ..streaming import rollup
from . import evaluation
from .evaluation import COUNTED, FC, LAB, QUALITY, several
from .market import FEATURES, HOURS, c, rounded, select

FOUND: dict = {}


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = (lambda spark, sf_dir: rounded(f(spark, sf_dir)), sql)
        return f

    return add


def candle_lines(spark, sf_dir, folder: str) -> None:
    """Hourly bars as candle files, one a symbol: times in milli- or microseconds, and lines that are too short or hold no numbers."""
    rows = tick_bars(spark, sf_dir, "hour")
    at = F.unix_millis("open_time") * F.when(F.hour("open_time") % 2 == 0, 1).otherwise(1000)
    parts = [at.cast("string"), *[c(x).cast("string") for x in ("open", "high", "low", "close", "volume")], (F.unix_millis("open_time") + 3_599_999).cast("string"), c("quote_asset_volume").cast("string"), c("num_trades").cast("string")]
    good = rows.select("symbol", F.concat_ws(",", *parts).alias("value"))
    bad = rows.where(F.hour("open_time") == 5).select("symbol", F.explode(F.array(F.concat_ws(",", *parts[:4]), F.concat(parts[0], F.lit(",1,2,x,1,1")), F.lit("open_time,open,high,low,close,volume"))).alias("value"))
    good.unionByName(bad).repartition("symbol").write.partitionBy("symbol").text(folder)


@query(select(HOURS, "hours", "symbol, open_time, num_trades", "open, high, low, close, volume"))
def ingest_bars(spark, sf_dir):
    """Candle files read back: broken lines are skipped."""
    folder = scratch(spark)
    candle_lines(spark, sf_dir, folder)
    return candles.ingest(spark, folder, "1h").select("symbol", "open_time", "num_trades", "open", "high", "low", "close", "volume")


@query("SELECT DISTINCT event_type AS symbol, event_type NOT IN ('click', 'error') AS ok FROM events")
def verify_manifest(spark, sf_dir):
    """Candle files against a manifest that lacks one of them and has a wrong digest for another."""
    folder, manifest = scratch(spark), scratch(spark)
    candle_lines(spark, sf_dir, folder)
    lines = candles.digests(spark, folder).where(~c("name").contains("symbol=click"))
    digest = F.when(c("name").contains("symbol=error"), F.reverse("digest")).otherwise(c("digest"))
    lines.select(F.concat_ws("  ", F.upper(digest), "name").alias("value")).write.text(manifest)
    return candles.verify_lines(spark, folder, manifest).groupBy(F.regexp_extract("name", "symbol=([^/]+)", 1).alias("symbol")).agg(F.bool_and("ok").alias("ok"))


@query("SELECT DISTINCT event_type || 'USDT' AS symbol FROM events WHERE event_type NOT IN ('error', 'view')")
def spot_symbols(spark, sf_dir):
    """Trading spot symbols from an exchange's document, in which one is halted and one may not be traded on the spot."""
    folder = scratch(spark)
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    each = kinds.withColumn("quote", F.explode(F.array(F.lit("USDT"), F.lit("BTC"))))
    permissions = F.when(c("event_type") == "view", F.array(F.lit("MARGIN"))).when(c("event_type") == "click", F.array(F.lit("SPOT"), F.lit("MARGIN")))
    one = F.struct(F.concat("event_type", "quote").alias("symbol"), F.when(c("event_type") == "error", "HALT").otherwise("TRADING").alias("status"), c("quote").alias("quoteAsset"), permissions.alias("permissions"))
    each.agg(F.to_json(F.struct(F.collect_list(one).alias("symbols"))).alias("value")).write.text(folder)  # one entry a symbol
    return candles.spot_symbols(spark, folder, "USDT")


@query(select(BARS, "bars WHERE open_time >= timestamp '1998-02-01' AND open_time < timestamp '1998-05-01'", "symbol, open_time", "close"))
def pruned_scan(spark, sf_dir):
    """Bars written by month and read back through the partitions of three months."""
    folder = scratch(spark)
    candles.write_bars(daily_bars(spark, sf_dir), folder)
    return candles.read_bars(spark, folder, "1998-02", "1998-04").select("symbol", "open_time", "close")


@query(select(FC, "fc WHERE trained", "symbol, horizon, open_time", "p_long, p_short"))
def read_forecasts(spark, sf_dir):
    folder = scratch(spark)
    rows = evaluation.baseline(spark, sf_dir).where("trained").withColumns({"model": F.lit("baseline"), "run_ts": F.lit("20240101T000000")})
    candles.write_forecasts(rows, folder)
    return candles.read_forecasts(spark, folder).select("symbol", "horizon", "open_time", "p_long", "p_short")


@query(select(f"{FEATURES}, {LAB.replace(BARS + ', ', '')}, cj AS (SELECT b.symbol, b.open_time, b.close, f3.rsi_14, lab.direction, lab.fwd_return FROM bars b LEFT JOIN f3 ON f3.symbol = b.symbol AND f3.open_time = b.open_time LEFT JOIN lab ON lab.symbol = b.symbol AND lab.open_time = b.open_time AND lab.horizon = 'week')", "cj", "symbol, open_time, direction", "close, rsi_14, fwd_return"))
def chart_join(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    made = features.build(bars).select("symbol", "open_time", "rsi_14")
    known = forecasts.labels(bars).where("horizon = 'week'").select("symbol", "open_time", "direction", "fwd_return")
    return bars.select("symbol", "open_time", "close").join(made, ["symbol", "open_time"], "left").join(known, ["symbol", "open_time"], "left")


@query(select(f"""{HOURS}, p AS (SELECT symbol, open_time + CASE WHEN hour(open_time) % 2 = 0 THEN interval 0 minute ELSE interval 30 minute END AS stamp FROM hours),
d AS (SELECT symbol, open_time::date AS day, min(open_time) AS first FROM hours GROUP BY 1, 2),
mb AS (SELECT p.symbol, p.stamp, coalesce(h.open_time, f.open_time) AS bar_time, coalesce(h.close, f.close) AS close FROM p LEFT JOIN hours h ON h.symbol = p.symbol AND h.open_time = p.stamp
 LEFT JOIN d ON d.symbol = p.symbol AND d.day = p.stamp::date LEFT JOIN hours f ON f.symbol = d.symbol AND f.open_time = d.first)""", "mb", "symbol, stamp, bar_time", "close"))
def match_bar(spark, sf_dir):
    """Times on and off the hour, matched to their bar or else to the first bar of their day."""
    hours = tick_bars(spark, sf_dir, "hour").select("symbol", "open_time", "close")
    at = F.when(F.hour("open_time") % 2 == 0, c("open_time")).otherwise(c("open_time") + F.expr("interval 30 minutes"))
    return forecasts.match_bar(hours.select("symbol", at.alias("at")), hours).withColumnRenamed("at", "stamp")


def held_lines(spark, sf_dir):
    """Forecasts as JSON lines, read back: every third day's stand seven hours after their bar, where only the date finds it."""
    folder = scratch(spark)
    names = list(d.HORIZONS)
    late = F.when(F.day("open_time") % 3 == 0, c("open_time") + F.expr("interval 7 hours")).otherwise(c("open_time"))
    candles.write_prediction_lines(evaluation.baseline(spark, sf_dir).where("trained").withColumn("open_time", late), folder, names, d.DEPTH_BINS)
    return candles.read_prediction_lines(spark, folder, names).drop("date")


def outcomes(spark, sf_dir):
    return stored.kept(stored.days(forecasts.labels(daily_bars(spark, sf_dir))), 8)


@query(select(f"{QUALITY}, ro AS (SELECT symbol, horizon, open_time, idx, target_time, fwd_return FROM q WHERE status = 'scored')", "ro", "symbol, horizon, open_time, target_time", "fwd_return"))
def realized_outcome(spark, sf_dir):
    """What came k bars after the bar that each stored forecast is matched to."""
    rows = stored.matched(stored.by_day(held_lines(spark, sf_dir).select("symbol", "horizon", "open_time")), outcomes(spark, sf_dir))
    return rows.where("direction is not null").select("symbol", "horizon", "open_time", "target_time", "fwd_return")


@query(select(QUALITY, "q", "symbol, horizon, open_time, target_time, status, predicted, predicted_bin, correct, flags, reason", "confidence, entropy, brier, nll, depth_kl, depth_js, depth_abs_error_pct, quality_score"))
def score_stored(spark, sf_dir):
    """Forecasts from JSON lines, matched to bars and scored."""
    lines = stored.kept(stored.by_day(stored.scored_forms(held_lines(spark, sf_dir))), 8)
    out = forecasts.scored(stored.matched(lines, outcomes(spark, sf_dir)))
    return out.select("symbol", "horizon", "open_time", "target_time", "status", "predicted", "predicted_bin", "correct", "flags", "reason", "confidence", "entropy", "brier", "nll", "depth_kl", "depth_js", "depth_abs_error_pct", "quality_score")


@query(select(f"{FC}", "fc WHERE trained", "symbol, horizon, open_time, list_extract(up, 1)::double = list_extract(up, 1) AS complete", "p_long, p_short"))
def read_prediction_lines(spark, sf_dir):
    """Forecasts written as JSON lines, beside lines that are broken, and read back."""
    folder = scratch(spark)
    names = list(d.HORIZONS)
    rows = evaluation.baseline(spark, sf_dir).where("trained")
    candles.write_prediction_lines(rows, folder, names, d.DEPTH_BINS)
    rows.select("symbol").distinct().select(F.concat(F.lit('{"open_time": '), "symbol").alias("value")).write.mode("append").text(folder)
    out = candles.read_prediction_lines(spark, folder, names)
    return out.select("symbol", "horizon", "open_time", (F.size("up") == len(d.DEPTH_BINS)).alias("complete"), "p_long", "p_short")


@query(select(QUALITY, "q", "symbol, horizon, open_time, status, array_to_string(flags; '|') AS flags", "confidence, quality_score").replace(";", ","))
def write_quality(spark, sf_dir):
    """The quality table written and read back."""
    folder = scratch(spark)
    candles.write_quality(evaluation.quality(spark, sf_dir), folder)
    return spark.read.parquet(folder).select("symbol", "horizon", "open_time", "status", "flags", "confidence", "quality_score")


@query(select(QUALITY, "(SELECT * FROM q WHERE status = 'scored' ORDER BY 100 - quality_score DESC, open_time, horizon, symbol LIMIT 100)", "symbol, horizon, predicted, direction", "quality_score, 100 - quality_score AS error_score"))
def write_worst(spark, sf_dir):
    """The worst forecasts as CSV, read back."""
    folder = scratch(spark)
    candles.write_worst(evaluation.quality(spark, sf_dir), folder)
    rows = spark.read.option("header", True).csv(folder)
    return rows.select("symbol", "horizon", "predicted", "direction", *[c(x).cast("double").alias(x) for x in ("quality_score", "error_score")])


SNAP = ["rsi_14", "log_return_7b", "rolling_vol_14"]


@query(select(f"{FEATURES}{QUALITY[len(BARS) :]}, sn AS (SELECT q.symbol, q.horizon, q.open_time, {', '.join(f'f3.{x} AS feat_{x}' for x in SNAP)} FROM q LEFT JOIN f3 ON f3.symbol = q.symbol AND f3.open_time = q.open_time)", "sn", "symbol, horizon, open_time", ", ".join(f"feat_{x}" for x in SNAP)))
def snapshot_join(spark, sf_dir):
    """Scored forecasts beside the features of their date's first bar."""
    rows = evaluation.quality(spark, sf_dir).select("symbol", "horizon", "open_time")
    return forecasts.snapshots(rows, features.build(daily_bars(spark, sf_dir)), SNAP)


#: Stored runs: both models, and the first again a month later without one symbol.
STAMPS = {"a1": "20240101T000000", "a20": "20240102T000000"}
AGAIN = "20240201T000000"


def stored_runs(spark, sf_dir):
    """Forecasts of three runs written and read back."""
    folder = scratch(spark)
    stamp = F.create_map(*[F.lit(x) for k, v in STAMPS.items() for x in (k, v)])
    rows = evaluation.two_models(spark, sf_dir).where("trained").select("symbol", "model", "interval", "horizon", "open_time", "p_long", "p_short").withColumn("run_ts", stamp[c("model")])
    again = rows.where("model = 'a1' and symbol <> 'N'").withColumn("run_ts", F.lit(AGAIN))
    candles.write_forecasts(rows.unionByName(again), folder)
    return candles.read_forecasts(spark, folder)


STORED = f"""{COUNTED}, {several('tw', evaluation.TWO_RUNS)}, sr0 AS (SELECT symbol, model, interval, horizon, open_time, CASE model WHEN 'a1' THEN '{STAMPS['a1']}' ELSE '{STAMPS['a20']}' END AS run_ts FROM tw WHERE trained),
sr AS (SELECT * FROM sr0 UNION ALL SELECT symbol, model, interval, horizon, open_time, '{AGAIN}' FROM sr0 WHERE model = 'a1' AND symbol <> 'N'), runs AS (SELECT symbol, model, interval, run_ts, count(*) AS rows, min(open_time) AS first, max(open_time) AS last, model || '_' || interval || '_' || run_ts AS slug FROM sr GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {STORED} SELECT symbol, model, interval, run_ts, rows, first, last, slug FROM runs")
def list_runs(spark, sf_dir):
    return forecasts.named_runs(stored_runs(spark, sf_dir)).orderBy(c("run_ts").desc())


@query(f"WITH {STORED}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY run_ts DESC) AS k FROM runs) SELECT symbol, model, run_ts, 'newest' AS asked FROM k WHERE k = 1 AND symbol IN ('A', 'N') UNION ALL SELECT symbol, model, run_ts, 'a1' FROM runs WHERE symbol = 'N' AND model = 'a1'")
def resolve_run(spark, sf_dir):
    """The newest run of two symbols, and one symbol's run of a model."""
    runs = forecasts.named_runs(stored_runs(spark, sf_dir))
    asked = [("A", None, "newest"), ("N", None, "newest"), ("N", "a1", "a1")]
    parts = [forecasts.resolve(runs, s, m).select("symbol", "model", "run_ts", F.lit(a).alias("asked")) for s, m, a in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {STORED} SELECT symbol, slug, model, interval, run_ts, true AS readable FROM runs")
def run_slug(spark, sf_dir):
    """Slugs of stored runs, taken apart again; a name with unsafe characters is refused."""
    runs = forecasts.named_runs(stored_runs(spark, sf_dir)).withColumn("p", d.slug_parts(c("slug")))
    return runs.select("symbol", "slug", "p.model", "p.interval", "p.run_ts", (c("p").isNotNull() & d.slug_parts(F.concat(F.lit("../"), "slug")).isNull()).alias("readable"))


NAMED = """nm AS (SELECT symbol, model, interval, replace(run_ts, 'T', '') AS ts FROM runs),
nv AS (SELECT symbol, model || '_1h_' || ts AS name, model, '1h' AS interval, ts AS run_ts FROM nm UNION ALL SELECT symbol, model || '_1h_1h_' || ts, model, '1h', ts FROM nm UNION ALL SELECT symbol, model || '_' || ts, model, '1d', ts FROM nm
  UNION ALL SELECT symbol, model || '_old_' || ts, model, '1d', 'old_' || ts FROM nm UNION ALL SELECT symbol, model || '_x', NULL, NULL, NULL FROM nm)"""


@query(f"WITH {STORED}, {NAMED} SELECT symbol, name, model, interval, run_ts FROM nv")
def run_names(spark, sf_dir):
    """Names of stored runs in every form there has been, taken apart; names of no run are refused."""
    runs = forecasts.named_runs(stored_runs(spark, sf_dir)).withColumn("ts", F.replace("run_ts", F.lit("T"), F.lit("")))
    hour = F.lit("1h")
    forms = [d.run_name(c("model"), c("ts"), hour), d.run_name(F.concat("model", F.lit("_1h")), c("ts"), hour), d.run_name(c("model"), c("ts")), d.run_name(c("model"), F.concat(F.lit("old_"), "ts")), d.run_name(c("model"), F.lit("x")), d.run_name(c("model"), F.lit("../x"))]
    rows = runs.select("symbol", F.explode(F.array_compact(F.array(*forms))).alias("name")).withColumn("p", d.run_parts(c("name")))
    return rows.select("symbol", "name", "p.model", "p.interval", "p.run_ts")


@query(f"WITH {STORED} SELECT symbol, model, run_ts, horizon, count(*) AS rows FROM sr WHERE run_ts = '{AGAIN}' GROUP BY ALL")
def orphan_artifacts(spark, sf_dir):
    """Tables derived from all stored runs, after the newest of them was deleted."""
    rows = stored_runs(spark, sf_dir)
    derived = rows.groupBy("symbol", "model", "run_ts", "horizon").agg(F.count(F.lit(1)).alias("rows"))
    return derived.join(forecasts.named_runs(rows.where(c("run_ts") != AGAIN)), ["symbol", "model", "run_ts"], "left_anti")


@query(f"WITH {STORED} SELECT DISTINCT symbol, model, horizon, date_trunc('month', open_time)::timestamp AS month, ('0x' || substr(md5('7|' || model || '|' || symbol || '|' || horizon || '|' || strftime(open_time, '%Y%m')), 1, 8))::bigint AS seed FROM sr")
def seed_key(spark, sf_dir):
    """A seed for every refit of the stored runs, from the base seed, model, symbol, horizon and month alone."""
    rows = stored_runs(spark, sf_dir).select("symbol", "model", "horizon", F.date_trunc("month", "open_time").alias("month")).distinct()
    name = F.concat_ws("|", F.lit("7"), "model", "symbol", "horizon", F.date_format("month", "yyyyMM"))
    return rows.withColumn("seed", F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"))


@query(f"WITH {FC}, b AS (SELECT DISTINCT symbol, horizon, unnest({d.DEPTH_BINS}) AS bin FROM fc WHERE trained), e AS (SELECT *, split_part(replace(bin, '+', ''), '-', 1)::double AS low FROM b) SELECT symbol, horizon, bin, low, CASE WHEN bin LIKE '%+' THEN low * 1.25 ELSE (low + split_part(bin, '-', 2)::double) / 2 END AS midpoint, low >= 13 AS large FROM e")
def depth_scheme(spark, sf_dir):
    """The depth bins that stored forecasts name, with their lower edge, midpoint and whether they hold large moves."""
    folder = scratch(spark)
    names = list(d.HORIZONS)
    candles.write_prediction_lines(evaluation.baseline(spark, sf_dir).where("trained"), folder, names, d.DEPTH_BINS)
    rows = candles.read_prediction_lines(spark, folder, names).select("symbol", "horizon", F.explode(F.map_keys("up")).alias("bin")).distinct()
    return rows.select("symbol", "horizon", "bin", d.bin_lower(c("bin")).alias("low"), d.bin_midpoint(c("bin")).alias("midpoint"), (d.bin_lower(c("bin")) >= d.LARGE_MOVE).alias("large"))


# ---- archives and the lake's files


def _zipped(folder: str):
    """Writes one archive a symbol, with a member a day, and returns their names."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name = f"{key[0]}-1h.zip"
        store, root = archives._opened(folder)
        with store.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for day, lines in pdf.sort_values("value").groupby("day"):
                archive.writestr(f"{key[0]}-1h-{day}.csv", "\r\n".join(lines["value"]))
        return pd.DataFrame({"name": [name]})

    return run


@query(select(HOURS, "hours", "symbol, open_time, num_trades", "open, high, low, close, volume"))
def ingest_archives(spark, sf_dir):
    """Candle lines in ZIP archives, one a symbol with a member a day, read back: broken lines are skipped."""
    folder, zips = scratch(spark), scratch(spark)
    candle_lines(spark, sf_dir, folder)
    first = F.try_element_at(F.split("value", ","), F.lit(1)).try_cast("bigint")
    day = F.coalesce(F.date_format(rollups.normalize_time(first), "yyyyMMdd"), F.lit("head"))
    store, root = archives._opened(zips)
    store.create_dir(root, recursive=True)
    rows = spark.read.text(folder).withColumn("day", day)
    settled(rows.groupBy("symbol").applyInPandas(_zipped(zips), "name string"))
    return archives.ingest(spark, zips, "1h").select("symbol", "open_time", "num_trades", "open", "high", "low", "close", "volume")


@query(select(f"{HOURS}, r4 AS (SELECT symbol, time_bucket(interval '4 hours', h.open_time, timestamp '1970-01-01') AS open_time, arg_min(open, h.open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, h.open_time) AS close, sum(volume) AS volume, count(*) AS n_source_bars FROM hours h GROUP BY 1, 2)", "r4", "symbol, open_time, n_source_bars", "open, high, low, close, volume"))
def rollup_stream(spark, sf_dir):
    """Four-hour bars of hourly bars that arrive in four micro-batches, in no order of time."""
    source, out, state = (scratch(spark) for _ in range(3))
    hours = tick_bars(spark, sf_dir, "hour")
    hours.repartition(4, "symbol", "open_time").write.parquet(source)
    stream = spark.readStream.schema(hours.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rollup.start(stream, "4h", out, state, "60 days", availableNow=True).awaitTermination()
    return rollup.read(spark, out, "4h").select("symbol", "open_time", "n_source_bars", "open", "high", "low", "close", "volume")


def lake(spark, sf_dir):
    """Listings of files of bars (days, three days and weeks, with holes), features and labels that Spark writes from the trades."""
    bars = daily_bars(spark, sf_dir)
    days = settled(bars.where(~((c("symbol") == "N") & ((F.year("open_time") * 12 + F.month("open_time")) % 17 == 0))))
    thirds = rollups.rollup(days, "3d").where("NOT (symbol = 'A' AND open_time >= timestamp '2001-09-01')")
    weeks = rollups.rollup(days, "1w").where("NOT (symbol = 'R' AND open_time >= timestamp '1998-03-01' AND open_time < timestamp '1998-06-01')")
    folders = [scratch(spark) for _ in range(3)]
    candles.write_bars(days, f"{folders[0]}/plain")
    candles.write_bars(thirds, f"{folders[0]}/plain")
    candles.write_weeks(weeks, f"{folders[0]}/weeks")
    returns = series.done(features.log_returns(series.chunked(series.indexed(days), 14))).select("symbol", "interval", "open_time", "log_return_1b")
    other = returns.where("symbol = 'A'").withColumn("interval", F.lit("12h")).unionByName(returns.where("symbol = 'R'").withColumn("interval", F.explode(F.array(F.lit("3d"), F.lit("1w")))))
    returns.unionByName(other).write.partitionBy("interval", "symbol").parquet(folders[1])
    known = forecasts.labels(days).select("symbol", "interval", "horizon", "open_time", "fwd_return").where("NOT (symbol = 'A' AND horizon = 'year')")
    known.unionByName(known.where("symbol = 'R'").withColumn("interval", F.lit("3d"))).write.partitionBy("interval", "symbol", "horizon").parquet(folders[2])
    return [candles.files(spark, f) for f in folders]


LAKE = f"""{BARS}, kb AS (SELECT * FROM bars WHERE NOT (symbol = 'N' AND (year(open_time) * 12 + month(open_time)) % 17 = 0)),
pr AS (SELECT symbol, '1d' AS interval, date_trunc('month', open_time)::date AS pt FROM kb UNION SELECT symbol, '3d', date_trunc('month', t)::date FROM (SELECT symbol, time_bucket(interval '3 days', open_time, timestamp '1970-01-01') AS t FROM kb) WHERE NOT (symbol = 'A' AND t >= timestamp '2001-09-01')
  UNION SELECT symbol, '1w', t::date FROM (SELECT symbol, date_trunc('week', open_time) AS t FROM kb) WHERE NOT (symbol = 'R' AND t >= timestamp '1998-03-01' AND t < timestamp '1998-06-01')),
mm AS (SELECT i.symbol, i.interval, b.pt FROM (SELECT DISTINCT symbol, interval FROM pr WHERE interval <> '1d') i JOIN pr b ON b.symbol = i.symbol AND b.interval = '1d'
  WHERE NOT EXISTS (SELECT 1 FROM pr p WHERE p.symbol = i.symbol AND p.interval = i.interval AND CASE WHEN i.interval = '1w' THEN p.pt BETWEEN date_trunc('week', b.pt)::date AND last_day(b.pt) ELSE p.pt = b.pt END)),
pf AS (SELECT symbol, interval, count(*) AS parts, min(pt) AS first, max(pt) AS last, greatest(0, CASE WHEN interval = '1w' THEN date_diff('day', min(pt), max(pt)) // 7 ELSE date_diff('month', min(pt), max(pt)) END + 1 - count(*)) AS gaps FROM pr GROUP BY symbol, interval),
iv AS (SELECT k.symbol, k.interval, coalesce(parts, 0) AS parts, coalesce(gaps, 0) AS gaps, first, last, (SELECT count(*) FROM mm WHERE mm.symbol = k.symbol AND mm.interval = k.interval) AS lacking, k.interval = '1d' OR k.symbol = 'R' OR k.interval = '12h' AS features,
  k.interval = '1d' AND k.symbol <> 'A' OR k.interval = '3d' AND k.symbol = 'R' AS labels FROM (SELECT DISTINCT symbol, interval FROM pr UNION SELECT DISTINCT symbol, '12h' FROM pr WHERE symbol = 'A') k LEFT JOIN pf USING (symbol, interval)),
lk AS (SELECT *, parts > 0 AS held, CASE WHEN parts = 0 OR gaps > 0 OR lacking > 0 THEN 'incomplete' WHEN features AND labels THEN 'complete' ELSE 'warning' END AS status,
  CASE WHEN parts = 0 THEN 'no bars' WHEN gaps > 0 THEN gaps || ' parts missing in between' WHEN lacking > 0 THEN 'behind the base by ' || lacking || ' months' WHEN NOT features THEN 'no features' WHEN NOT labels THEN 'no labels of every horizon' END AS reason FROM iv)"""


@query(f"WITH {LAKE} SELECT symbol, interval, pt AS month FROM mm")
def missing_months(spark, sf_dir):
    """Months of daily bars that the coarser intervals' files lack, weeks by their ISO weeks."""
    return inventory.missing_months(inventory.present(settled(lake(spark, sf_dir)[0])), "1d").withColumnRenamed("at", "month")


@query(f"WITH {LAKE} SELECT symbol, interval, parts, gaps, lacking, features, labels, held, status, reason FROM lk")
def lake_inventory(spark, sf_dir):
    """Parts, gaps, lags, features, labels, status and reason of every symbol and interval, from the files' listing alone."""
    out = inventory.intervals(*lake(spark, sf_dir), "1d")
    return out.select("symbol", "interval", "parts", "gaps", "lacking", "features", "labels", (c("bytes") > 0).alias("held"), "status", "reason")


@query(f"""WITH {LAKE}, sy AS (SELECT symbol, max(first) FILTER (interval = '1d') AS first, last_day(max(last) FILTER (interval = '1d')) AS last, max(parts) FILTER (interval = '1d') AS months, max(lk.gaps) FILTER (interval = '1d') AS gaps,
  string_agg(interval, ', ' ORDER BY interval) FILTER (lk.gaps > 0) AS gapped, string_agg(interval, ', ' ORDER BY interval) FILTER (lk.gaps = 0 AND parts > 0 AND lacking > 0) AS behind, string_agg(interval, ', ' ORDER BY interval) FILTER (parts = 0) AS nothing, string_agg(interval, ', ' ORDER BY interval) FILTER (status = 'warning') AS unmade FROM lk GROUP BY symbol)
SELECT symbol, first, last, months, gaps, CASE WHEN coalesce(gapped, behind, nothing) IS NOT NULL THEN 'incomplete' WHEN unmade IS NOT NULL OR symbol = 'R' THEN 'warning' ELSE 'complete' END AS status,
  coalesce('gaps in ' || gapped, 'behind the base: ' || behind, 'no bars of ' || nothing, 'no features or labels of ' || unmade, CASE WHEN symbol = 'R' THEN 'checks failed' END) AS reason FROM sy""")
def lake_symbols(spark, sf_dir):
    """The verdict on each symbol of the lake; one of them failed its checks."""
    bars, made, known = lake(spark, sf_dir)
    failed = bars.where("symbol = 'R'").select("symbol")
    return inventory.symbols(inventory.intervals(bars, made, known, "1d"), failed, "1d").drop("bytes")


@query(f"""WITH {LAKE}, rs AS (SELECT symbol, interval, unnest(list_filter([CASE WHEN interval = '1d' AND gaps > 0 THEN 1 END, CASE WHEN interval <> '1d' AND status = 'incomplete' THEN 2 END, CASE WHEN interval <> '1d' AND status = 'incomplete' OR status = 'warning' THEN 3 END], lambda x: x IS NOT NULL)) AS step FROM lk)
SELECT rs.symbol, step, ['ingest', 'rollup', 'features'][step] AS action, string_agg(rs.interval, ', ' ORDER BY rs.interval) AS intervals, b.first, last_day(b.last) AS last FROM rs JOIN iv b ON b.symbol = rs.symbol AND b.interval = '1d' GROUP BY ALL""")
def lake_repairs(spark, sf_dir):
    """What mends the lake, in order."""
    return inventory.repairs(inventory.intervals(*lake(spark, sf_dir), "1d"), "1d")


def queries() -> dict:
    return {k: v[0] for k, v in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in FOUND.items() if v[1]}
