"""The lake's files, archives, stored forecasts, correlations and other statistics against hand values and brute force."""

import re
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import domain as d
from tidemark.operators import correlation, forecasts, inventory, learning, quality, rollups, significance, stored
from tidemark.sources import archives, candles

c = F.col
FILE = "path string, bytes long, symbol string, interval string, horizon string, year int, month int, week int"


def listing(spark, rows):
    return spark.createDataFrame([("p", b, s, i, h, y, m, w) for s, i, h, y, m, w, b in rows], FILE)


@pytest.fixture(scope="module")
def lake(spark):
    """A: gapped base, hours behind; B: weeks in place of months, all made; C: features without bars."""
    bars = [("A", "1m", None, 2020, m, None, 10) for m in (1, 2, 4)] + [("A", "1h", None, 2020, m, None, 5) for m in (1, 2)] + [("A", "1d", None, 2020, 1, None, 0)]
    bars += [("B", "1m", None, 2020, m, None, 10) for m in (1, 2, 3)] + [("B", "1w", None, 2020, None, w, 1) for w in range(5, 12)]
    made = [("A", "1h", None, None, None, None, 1), ("B", "1m", None, None, None, None, 1), ("B", "1w", None, None, None, None, 1), ("C", "1d", None, None, None, None, 1)]
    known = [("B", i, h, None, None, None, 1) for i in ("1m", "1w") for h in d.HORIZONS] + [("A", "1h", "week", None, None, None, 1)]
    return [listing(spark, x) for x in (bars, made, known)]


def test_months_that_intervals_lack(lake):
    got = {(r["symbol"], r["interval"], str(r["at"])) for r in inventory.missing_months(inventory.present(lake[0])).collect()}
    assert got == {("A", "1h", "2020-04-01")}  # of B every month holds a day of an ISO week that is there: week 5 begins on January 27


def test_inventory_ladder_and_repairs(spark, lake):
    found = inventory.intervals(*lake)
    got = {(r["symbol"], r["interval"]): r for r in found.collect()}
    assert [(got[k]["status"], got[k]["gaps"], got[k]["lacking"]) for k in (("A", "1m"), ("A", "1h"), ("B", "1m"), ("B", "1w"), ("C", "1d"))] == [("incomplete", 1, 0), ("incomplete", 0, 1), ("complete", 0, 0), ("complete", 0, 0), ("incomplete", 0, 0)]
    assert got["C", "1d"]["reason"] == "no bars" and got["A", "1h"]["reason"] == "behind the base by 1 months" and ("A", "1d") not in got and got["B", "1w"]["bytes"] == 7
    by = {r["symbol"]: r for r in inventory.symbols(found, spark.createDataFrame([("B",)], "symbol string")).collect()}
    assert (by["A"]["status"], by["A"]["reason"], by["A"]["months"], by["A"]["gaps"], str(by["A"]["last"])) == ("incomplete", "gaps in 1m", 3, 1, "2020-04-30")
    assert (by["B"]["status"], by["B"]["reason"]) == ("warning", "checks failed") and by["C"]["reason"] == "no bars of 1d"
    steps = [(r["symbol"], r["step"], r["action"], r["intervals"]) for r in inventory.repairs(found).orderBy("symbol", "step").collect()]
    assert steps == [("A", 1, "ingest", "1m"), ("A", 2, "rollup", "1h"), ("A", 3, "features", "1h")]  # C has no base to start from
    empty = [x.limit(0) for x in lake]
    assert inventory.intervals(*empty).count() == inventory.symbols(inventory.intervals(*empty)).count() == 0


def test_archives_of_several_members(spark, tmp_path):
    good = [f"{1_600_000_000_000 + 3_600_000 * i},1.5,2,1,1.75,{i}" for i in range(5000)]
    with zipfile.ZipFile(tmp_path / "AAA-1h.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "open_time,open,high,low,close,volume\n" + "\n".join(good[:2500]) + "\n")
        z.writestr("b.csv", "\r\n".join([*good[2500:], "1,2,3", "x,1,2,3,4,5", ""]))
        z.writestr("empty.csv", "")
    (tmp_path / "deep").mkdir()
    with zipfile.ZipFile(tmp_path / "deep" / "BBB-1h.zip", "w") as z:
        z.writestr("c.csv", good[0])
    (tmp_path / "note.txt").write_text("no archive")
    bars = archives.ingest(spark, str(tmp_path), "1h")
    got = {r["symbol"]: (r["n"], r["v"]) for r in bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("v")).collect()}
    assert got == {"AAA": (5000, float(sum(range(5000)))), "BBB": (1, 0.0)} and archives.lines(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    assert archives.ingest(spark, str(tmp_path / "deep"), "1h").count() == 1


def test_files_are_listed_by_their_folders(spark, tmp_path):
    bars = spark.createDataFrame([("s", i * 86400, 1.0) for i in range(40)], "symbol string, at long, close double").select("symbol", F.lit("1w").alias("interval"), F.timestamp_seconds("at").alias("open_time"), "close")
    candles.write_weeks(bars, str(tmp_path / "w"))
    found = candles.files(spark, str(tmp_path / "w"))
    assert {(r["symbol"], r["interval"], r["year"], r["week"]) for r in found.collect()} == {("s", "1w", *pd.Timestamp(i, unit="D").isocalendar()[:2]) for i in range(40)} and found.where("bytes = 0").count() == 0


def test_order_of_ingest(spark, tmp_path):
    """Files in a known wrong order: every bar after a later one is found, across parts of files and files."""
    times = [5, 6, 7, 1, 2, 9, 8, 10, 3, 11]
    for k, part in enumerate((times[:4], times[4:7], times[7:])):
        spark.createDataFrame([("s", "1d", t) for t in part] + [("ok", "1d", 100 * k + t) for t in range(3)], "symbol string, interval string, t long").withColumn("open_time", F.timestamp_seconds("t")).coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
    folder = tmp_path / "all"
    folder.mkdir()
    for k in range(3):
        next((tmp_path / f"f{k}").glob("*.parquet")).rename(folder / f"{k}.parquet")
    for size in (1 << 16, 2):
        quality.FILE_ROWS = size
        rows = quality.ingested(spark, str(folder))
        back = sorted(r["open_time"].timestamp() for r in quality.steps_back(rows).where("symbol = 's'").collect())
        assert back == sorted(b for a, b in zip(times, times[1:]) if b < a)
        assert {r["symbol"]: r["sorted"] for r in quality.sortedness(rows).collect()} == {"s": False, "ok": True}
    quality.FILE_ROWS = 1 << 16


def test_stored_forecasts_meet_bars_without_a_shuffle(spark):
    bars = spark.createDataFrame([("s", "1h", i * 3600, float(100 + i)) for i in range(240)], "symbol string, interval string, at long, close double").withColumn("open_time", F.timestamp_seconds("at")).drop("at")
    known = stored.kept(stored.days(forecasts.labels(bars, {"day": 24})), 4)
    asked = spark.createDataFrame([("s", "day", 10 * 3600), ("s", "day", 10 * 3600 + 600), ("s", "day", 230 * 3600), ("s", "day", 10**7), ("other", "day", 0)], "symbol string, horizon string, at long").withColumn("open_time", F.timestamp_seconds("at")).drop("at")
    kept = stored.kept(stored.by_day(asked), 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = stored.matched(kept, known)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {(r["symbol"], int(r["at"].timestamp())): r for r in out.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert got["s", 36000]["idx"] == 10 and got["s", 36000]["fwd_return"] == 134 / 110 - 1 and got["s", 36600]["idx"] == 0  # the first bar of its day
    assert got["s", 230 * 3600]["idx"] == 230 and got["s", 230 * 3600]["fwd_return"] is None and got["s", 10**7]["idx"] is None and got["other", 0]["idx"] is None


@pytest.mark.parametrize("blocks", [256, 2])
def test_pair_correlations(spark, monkeypatch, blocks):
    monkeypatch.setattr(correlation, "BLOCK_SYMBOLS", blocks)
    monkeypatch.setattr(correlation, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.normal(5, 1, (200, 6)) + rng.normal(0, 1, (200, 1)), columns=list("abcdef"))
    frame["e"] = 1.0
    frame = frame.mask(rng.random(frame.shape) < 0.2)
    rows = [("week", s, i, None if pd.isna(v) else float(v)) for s in frame for i, v in enumerate(frame[s])]
    got = {(r["s1"], r["s2"]): r for r in correlation.pairs(spark.createDataFrame(rows, "horizon string, symbol string, open_time long, v double"), "v", ["horizon"]).collect()}
    assert set(got) == {(a, b) for a in frame for b in frame if a < b}
    for (a, b), r in got.items():
        both = frame[[a, b]].dropna()
        assert r["n"] == len(both)
        assert r["r"] is None if "e" in (a, b) else abs(r["r"] - both[a].corr(both[b])) < 1e-9


def test_a_median_and_its_interval(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(4, 2000)
    rows = spark.createDataFrame([("s", 5, i, float(v)) for i, v in enumerate(x)], "symbol string, forward int, idx long, x double")
    edges = np.linspace(0, 20, 81).tolist()
    got = significance.statistic_interval(rows, ["symbol"], *significance.median_of(c("x"), edges), resamples=200, reference=3.0).first()
    assert abs(got["value"] - np.median(x)) < 0.1 and got["low"] < got["value"] < got["high"] and got["high"] - got["low"] < 1.5
    ratio = significance.statistic_interval(rows, ["symbol"], {"a": c("x"), "b": c("x") * c("x")}, lambda s, n: s("b") / s("a"), 100).first()
    assert abs(ratio["value"] - (x * x).sum() / x.sum()) < 1e-9


def test_forecasters_have_names(spark):
    pool = spark.createDataFrame([("s", "week")], "symbol string, horizon string")
    with pytest.raises(ValueError, match="no forecaster nobody; known are boosted, ml"):
        learning.forecast("nobody", pool, [], pool)
    with pytest.raises(ValueError, match="there is a forecaster named ml"):
        learning.register("ml", lambda *_: pool)
    learning.register("short", lambda *_: pool)
    with pytest.raises(ValueError, match="lack open_time"):
        learning.forecast("short", pool, [], pool)
    del learning.FORECASTERS["short"]


def test_names_of_runs(spark):
    names = {
        "ml_1d_20240501123000": ("ml", "1d", "20240501123000"), "ml_1d_1d_20240501123000": ("ml", "1d", "20240501123000"), "xgboost_20240501123000": ("xgboost", "1d", "20240501123000"), "a_b_1h_20240501123000": ("a_b", "1h", "20240501123000"),
        "a_b_20240501123000": ("a", "1d", "b_20240501123000"), "ml_1d_2024": None, "plain": None,
    }
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", d.run_parts(c("name")).alias("p")).collect()
    assert {r["name"]: tuple(r["p"]) if r["p"] else None for r in rows} == names
    bad = spark.createDataFrame([("a/b",), ("..",), ("a\\b",), ("",), (None,), ("ok",)], "m string").select(d.run_name(c("m"), F.lit("20240501123000"), F.lit("1d")).alias("n"))
    assert [r["n"] for r in bad.collect()] == [None] * 5 + ["ok_1d_20240501123000"]


def test_intervals_that_cannot_be_made(spark):
    assert rollups.asked("4h, 1d 7x,1d") == ["4h", "1d", "7x"] and inventory.unsupported(["1d", "7x", "2y"]) == ["2y", "7x"]
    bars = spark.createDataFrame([("s", "1h", i * 3600, 1.0) for i in range(48)], "symbol string, interval string, at long, close double").withColumn("open_time", F.timestamp_seconds("at")).drop("at")
    for x in ("open", "high", "low", "volume"):
        bars = bars.withColumn(x, c("close"))
    made, report = rollups.rollup_each(bars, "1d 7x 1m")
    assert {r["interval"]: (r["bars"], r["error"]) for r in report.collect()} == {"1d": (2, None), "7x": (0, "unsupported interval"), "1m": (0, "finer than the source")} and made.count() == 2
    made, report = rollups.rollup_each(bars, "7x")
    assert made.count() == 0 and report.first()["error"] == "unsupported interval"


def test_worst_rows_and_pooled_power(spark):
    rows = spark.createDataFrame([(f"s{i}", "week", i, "scored" if i % 5 else "missing_target", float(i % 7), ["high_entropy"] if i % 2 else []) for i in range(60)], "symbol string, horizon string, open_time long, status string, error_score double, flags array<string>")
    got = forecasts.worst(rows, 4, "high_entropy").collect()
    assert [r["error_score"] for r in got] == [6.0, 6.0, 6.0, 5.0] and {r["total"] for r in got} == {24} and forecasts.worst(rows, 0).count() == 1
    facts = spark.createDataFrame([("week", 7, 2500, 2400), ("year", 364, 2500, 500)], "horizon string, forward int, n int, scored int")
    rho = spark.createDataFrame([("week", 3, 0.5), ("year", 3, 1.0)], "horizon string, symbols long, correlation double")
    got = {r["horizon"]: r for r in forecasts.pooled_power(facts, rho).collect()}
    assert got["week"]["low"] == [] and abs(got["week"]["effective"] - 1.5) < 1e-12 and abs(got["week"]["train_power"] - 730 / 7 * 1.5) < 1e-9
    assert got["year"]["low"] == ["training window", "scored range"] and re.match("scored", got["year"]["low"][1])
