"""Operators over bars: SQL agreement on the smallest tables, hand values and properties."""

import contextlib
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import domain as d
from tidemark.operators import features, forecasts, quality, rollups, series, significance
from tidemark.operators import learning as learners
from tidemark.plans import evaluation, files, learning, market, study
from tidemark.sources import candles, tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (market, evaluation, files, study, learning)
SQL = {k: v for p in PLANS for k, v in p.oracle_sql().items()}
QUERIES = {k: v for p in PLANS for k, v in p.queries().items()}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5)
        return [one(v) for v in x] if isinstance(x, list) else x.isoformat() if hasattr(x, "isoformat") else x

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


FAST = ["to_bars", "rollup_bars", "rollup_many", "qa_report", "gaps_chart", "inventory", "build_features", "intraday_daily", "forward_labels", "training_slice", "baseline_forecast", "metrics_by_horizon", "graded_sequence", "replay_roi", "accuracy_ci", "match_bar", "chart_join", "score_forecasts", "pair_forecasts", "mistimed_replay", "calibrate_forecasts", "holdout_split", "pool_contributions", "qa_sorted", "return_correlation", "score_stored", "realized_outcome", "ingest_archives", "lake_inventory", "lake_repairs", "run_names", "rollup_report", "sharpness", "median_error_ci", "named_forecaster", "architecture_spread", "verify_manifest", "list_runs", "read_prediction_lines"]
if os.environ.get("ALL_SQL"):  # every query that has SQL; some minutes
    FAST = sorted(SQL)


@pytest.mark.parametrize("name", FAST)
def test_sql_agrees(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = duck.sql(f"select {', '.join(f'"{n}"' for n in names)} from ({SQL[name]})").fetchall()
    assert plain(map(tuple, got.select(*names).collect())) == plain(want) and want


@pytest.fixture(scope="module")
def zero_closes(spark, tmp_path_factory):
    """Events whose minutes close at 0 on the way, at the start, twice in a row, all day, and never."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    days = {"way": [5, 0, 7, 7], "start": [0, 3, 3.3], "twice": [4, 0, 0, 2], "all": [0, 0], "never": [2, 3, 2.5]}
    rows = [(k * 10 + i, f"2024-01-0{1 + k % 2} 00:0{i}:00", name, i, float(x), '{"k": 1}') for k, (name, closes) in enumerate(days.items()) for i, x in enumerate(closes)]
    made = spark.createDataFrame(rows, "event_id long, ts string, event_type string, user_id long, value double, props string")
    made.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{folder}/events.parquet")
    return folder


def told(rows):
    """Rows with every number told from the others, none from null."""
    return sorted(tuple(str(x) for x in r) for r in rows)


def zeros_agree(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    got = QUERIES[name](spark, folder)
    assert told(got.collect()) == told(con.sql(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall())
    return got


def test_intraday_daily_after_a_close_of_zero(spark, zero_closes):
    got = {r["symbol"]: r for r in zeros_agree(spark, zero_closes, "intraday_daily").collect()}
    assert got["way"]["realized_vol_1d"] == float("inf") and got["way"]["jump_count"] == 2
    assert math.isnan(got["all"]["realized_vol_1d"]) and math.isnan(got["all"]["max_intraday_drawdown"])


def test_join_intraday_after_a_close_of_zero(spark, zero_closes):
    got = {r["symbol"]: r for r in zeros_agree(spark, zero_closes, "join_intraday").collect()}
    assert got["start"]["realized_vol_1d"] == float("inf") and got["never"]["jump_count"] == 2


def test_join_intraday_of_unknown_prices_times_and_ids(spark, tmp_path):
    """Prices that are null are neither first nor last, unknown ids come last, unknown times have no close, and a day of one bar no count of jumps."""
    days = {"gaps": [None, 3, 4, None], "none": [None], "one": [5], "nan": [float("nan"), 2, 3]}
    rows = [(10 * k + i, f"2024-01-02 00:0{i}:00", name, i, x if x is None else float(x), '{"k": 1}') for k, (name, closes) in enumerate(days.items()) for i, x in enumerate(closes)]
    rows += [(90, None, "gaps", 1, 7.0, "{}"), (91, None, None, None, 8.0, None), (92, "2024-01-02 00:01:00", None, 1, 9.0, "{}")]
    rows += [(None, "2024-01-02 00:00:00", "ids", 1, 1.0, "{}"), (93, "2024-01-02 00:00:00", "ids", 1, 2.0, "{}"), (94, "2024-01-02 00:01:00", "ids", 1, 4.0, "{}")]
    made = spark.createDataFrame(rows, "event_id long, ts string, event_type string, user_id long, value double, props string")
    made.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["symbol"], r["open_time"] is not None): r for r in zeros_agree(spark, str(tmp_path), "join_intraday").collect()}
    assert got["gaps", True]["close"] == 4 and got["gaps", True]["jump_count"] == 1 and got["gaps", False]["close"] is None
    assert got["one", True]["jump_count"] is None and got["ids", True]["realized_vol_1d"] == 9


class Reached(Exception):
    pass


@pytest.mark.parametrize("name", ["run_summary", "backtest_summary", "walk_forward", "top_features", "depth_model"])
def test_line_items_are_rolled_up_once(spark, sf, monkeypatch, name):
    """Bars are a table of their own, made once a query; what is planned over them reads no line items. Fits are left out."""
    made, rolled = [], tables._rolled
    monkeypatch.setattr(tables, "_rolled", lambda *a: made.append(1) or rolled(*a))

    def reached(*a):
        raise Reached

    monkeypatch.setattr(learners, "fitted", reached)
    monkeypatch.setattr(learners, "sliced", reached)
    out = None
    with contextlib.suppress(Reached):
        out = QUERIES[name](spark, sf)
    assert len(made) == 1 and (out is None or not any("lineitem" in x for x in out.inputFiles()))


@pytest.mark.parametrize("name", ["walk_forward", "top_features", "depth_model"])
def test_line_items_are_added_up_without_a_sort(spark, sf, monkeypatch, name):
    """Numbers are added up by hash, and the whole order is looked at for trades at its ends alone, beside which no line item is shuffled."""
    plans, kept = [], tables.settled

    def settled(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0])
        return kept(df)

    def reached(*a):
        raise Reached

    monkeypatch.setattr(tables, "settled", settled)
    monkeypatch.setattr(learning, "pooled", reached)
    with contextlib.suppress(Reached):
        QUERIES[name](spark, sf)
    assert len(plans) == 2 and all("lineitem" in x for x in plans)
    assert "HashAggregate" in plans[0] and "Sort" not in plans[0]
    read = plans[1].partition("BroadcastHashJoin")[2].partition("lineitem")[0]
    assert read and "Exchange" not in read and "Sort" not in read


def test_bars_of_unknown_orders_prices_and_keys(spark, tmp_path):
    """Bars found at the ends of the first ordering column are those of the whole order: ties go to the next columns, nulls come last, null keys have bars."""
    of = lambda key, line, price, symbol="X", day=1, qty=2.0: (key, line, 1, 1, qty, price, symbol, "F", None if day is None else f"2001-01-0{day} 00:00:00")
    rows = [of(1, 2, 12.0), of(1, 1, 10.0), of(4, 1, 30.0), of(4, 9, 36.0), of(4, 5, 34.0), of(0, 1, None), of(9, 1, None)]
    rows += [of(None, 1, 14.0, day=2), of(None, None, 16.0, day=2), of(3, 1, 18.0, day=2), of(None, 2, 14.0, day=3), of(None, 1, 16.0, day=3)]
    rows += [of(1, 1, None, day=4), of(5, 1, 8.0, None), of(6, 1, 9.0, None), of(7, 1, 3.0, day=None), of(8, 1, 4.0, None, None), of(8, 2, 4.0, day=5, qty=0.0)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate string"
    spark.createDataFrame(rows, names).withColumn("l_shipdate", F.to_timestamp_ntz("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["to_bars"](spark, str(tmp_path))
    assert told(got.collect()) == told(con.sql(f"select {', '.join(got.columns)} from ({SQL['to_bars']})").fetchall())
    assert got.where("symbol = 'X' AND open_time = timestamp '2001-01-01'").select("open", "close", "num_trades").first() == (5, 18, 7)


def bars_of(spark, closes, symbol="s", step=86400):
    rows = [(symbol, "1d", i * step, float(x) if x is not None else None) for i, x in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, interval string, at long, close double").withColumn("open_time", F.timestamp_seconds("at")).drop("at")


def test_chunks_do_not_show(spark):
    """Windows over chunks give what a window over the series gives."""
    closes = [100 + 10 * math.sin(i / 5) + i % 7 for i in range(1500)]
    rows = series.chunked(series.indexed(bars_of(spark, closes)), 30, 0, 100)
    rows = rows.join(series.ewm_before(rows, {"before": (F.col("close"), 14)}), ["symbol", "interval", "chunk"])
    out = series.done(rows.withColumns({"e": series.ewm(F.col("close"), 14, F.col("before")), "m": series.full(F.avg("close"), F.col("close"), 30)})).orderBy("idx").collect()
    a, e = 2 / 15, closes[0]
    for i, r in enumerate(out):
        e = e if i == 0 else (1 - a) * e + a * closes[i]
        assert abs(r["e"] - e) < 1e-9
        assert (r["m"] is None) == (i < 29) and (r["m"] is None or abs(r["m"] - sum(closes[i - 29 : i + 1]) / 30) < 1e-9)


def test_labels_of_awkward_closes(spark):
    closes = [100, 101, None, 0, 105, 105, float("nan"), 110, 50]
    got = {r["idx"]: r for r in forecasts.labels(bars_of(spark, closes), {"one": 1}).collect()}
    assert [got[i]["direction"] for i in range(9)] == ["long", None, None, None, None, None, None, "short", None]
    assert got[4]["fwd_return"] == 0.0 and got[4]["depth_bin"] is None and got[7]["depth_bin"] == d.DEPTH_BINS.index("34-55")


def test_no_look_ahead(spark):
    """A forecast does not change when the bars after it do."""
    closes = [100 * math.exp(0.01 * math.sin(i * 0.7)) for i in range(900)]
    other = closes[:850] + [x * 3 for x in closes[850:]]
    h = {"week": 7}
    a, b = ({r["idx"]: (r["p_long"], r["up"]) for r in forecasts.baseline(forecasts.labels(bars_of(spark, x), h), 1.0, h).collect()} for x in (closes, other))
    assert all(a[i] == b[i] for i in range(851)) and a[800][0] is not None


def test_mirror_symmetry(spark):
    rows = spark.createDataFrame([(0.7, 0.3, [0.1] * 12, [0.05] * 12)], "p double, q double, u array<double>, v array<double>")
    c = F.col
    r = rows.select(d.risk(c("p"), c("q"), c("u"), c("v")).alias("a"), d.risk(c("q"), c("p"), c("v"), c("u")).alias("b"), d.expected_move(c("p"), c("q"), c("u"), c("v")).alias("x"), d.expected_move(c("q"), c("p"), c("v"), c("u")).alias("y")).first()
    assert r["a"] == r["b"] and abs(r["x"] + r["y"]) < 1e-12


def test_hand_values(spark):
    one = spark.range(1)
    r = one.select(d.effective_samples(F.lit(2040), F.lit(28)).alias("a"), d.effective_symbols(F.lit(3.0), F.lit(0.6)).alias("b"), d.interval_steps(F.lit(91), F.lit("1w")).alias("s"), d.interval_steps(F.lit(1), F.lit("nope")).alias("n")).first()
    assert round(r["a"], 1) == 72.9 and round(r["b"], 3) == 1.364 and r["s"] == 13
    assert [forecasts.default_window(k) for k in d.HORIZONS.values()] == [737, 758, 821, 1456]
    p = spark.createDataFrame([("a", "w", 0.01), ("b", "w", 0.04), ("c", "w", 0.03), ("d", "w", 0.005)], "symbol string, horizon string, p_value double")
    got = {r["symbol"]: round(r["q_value"], 6) for r in significance.benjamini_hochberg(p).collect()}
    assert got == {"a": 0.02, "b": 0.04, "c": 0.04, "d": 0.02}


def test_bootstrap_equals_brute_force(spark):
    import hashlib

    import numpy as np

    xs = {("a", "w", 7): [float(i * i % 5 < 3) for i in range(101)], ("b", "m", 70): [1.0] + [0.0] * 699, ("c", "w", 7): [1.0] * 69}
    rows = spark.createDataFrame([(*k, i, x) for k, v in xs.items() for i, x in enumerate(v)], "symbol string, horizon string, forward int, pos long, x double")
    got = {r["symbol"]: r for r in significance.mean_interval(rows).collect()}
    for (s, h, f), v in xs.items():
        n, means = len(v), []
        for b in range(2000):
            starts = [int(hashlib.md5(f"{s}|{h}|{b}|{k}".encode()).hexdigest()[:8], 16) % (n - f + 1) for k in range(-(-n // f))]
            means.append(np.mean([v[j] for k in starts for j in range(k, k + f)][:n]))
        low, high = np.quantile(means, [0.025, 0.975])
        ok = n / f >= 10 and low <= np.mean(v) <= high
        assert ok == (s == "a") and (got[s]["low"] is not None) == ok == (got[s]["high"] is not None) == (got[s]["p_value"] is not None)
        if ok:
            p = min(1.0, 2 * (min(sum(m <= 0.5 for m in means), sum(m >= 0.5 for m in means)) + 1) / 2001)
            assert abs(got[s]["low"] - low) < 1e-9 and abs(got[s]["high"] - high) < 1e-9 and abs(got[s]["p_value"] - p) < 1e-9 and got[s]["resamples"] == 2000


def test_month_shares_need_twenty_samples(spark):
    months = spark.createDataFrame([("a", "w", k, 19 + (k > 0), 0.6) for k in range(7)] + [("b", "w", k, 19, 0.6) for k in range(7)], "symbol string, horizon string, month int, samples long, accuracy double")
    assert [(r["symbol"], r["months"], r["share"]) for r in evaluation.shares(months).collect()] == [("a", 6, 1.0)]


def test_quality_checks_find_planted_faults(spark):
    rows = bars_of(spark, [1, 2, 3, 4]).withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0)})
    bad = rows.unionByName(rows.limit(1)).withColumn("high", F.when(F.col("close") == 3, 0.5).otherwise(F.col("high")))
    assert quality.duplicates(bad).count() == 1
    assert {r["kind"] for r in quality.ohlc_violations(bad).collect()} == {"high_below_body"}
    assert quality.gaps(rows.where("close <> 2"), 86400).count() == 1


def test_candles_from_files(spark, tmp_path):
    (tmp_path / "AAA-1m.csv").write_text("1700000000000,1,2,0.5,1.5,10,1700000059999,15,3,5,7,0\nopen_time,x\n1700000060000000,1,2,0.5,bad,10\n1700000120000000,2,3,1,2.5,11\n\n1,2,3\n")
    rows = candles.ingest(spark, str(tmp_path / "*.csv"), "1m").orderBy("open_time").collect()
    assert [(r["symbol"], r["close"], r["num_trades"]) for r in rows] == [("AAA", 1.5, 3), ("AAA", 2.5, None)]
    import hashlib

    data = (tmp_path / "AAA-1m.csv").read_bytes()
    (tmp_path / "AAA-1m.csv.CHECKSUM").write_text(hashlib.sha256(data).hexdigest() + "  AAA-1m.csv\n")
    (tmp_path / "BBB-1m.csv").write_text("x")
    got = {r["name"]: r["ok"] for r in candles.verify(spark, str(tmp_path)).collect()}
    assert got == {"AAA-1m.csv": True, "BBB-1m.csv": False}


def test_forecast_files_round_trip(spark, sf, tmp_path):
    rows = evaluation.baseline(spark, sf).where("trained").select("symbol", "interval", "horizon", "open_time", "p_long", "p_short", "trained").withColumns({"model": F.lit("m"), "run_ts": F.lit("20240101T000000")})
    candles.write_forecasts(rows, str(tmp_path / "f"))
    again = candles.read_forecasts(spark, str(tmp_path / "f"))
    assert again.count() == rows.count() and set(rows.columns) <= set(again.columns)


def test_rollup_widths(spark):
    rows = bars_of(spark, range(1, 121), step=60).withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.lit(1.0)})
    got = rollups.rollup(rows, "1h").orderBy("open_time").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"], r["n_source_bars"]) for r in got] == [(1.0, 61.0, 0.0, 60.0, 60.0, 60), (61.0, 121.0, 60.0, 120.0, 60.0, 60)]


def test_scale_free_features(spark, sf):
    bars = market.daily_bars(spark, sf).where("symbol = 'A'")
    scaled = bars.withColumns({x: F.col(x) * 7.0 for x in ("open", "high", "low", "close")})
    names = ["log_return_7b", "rolling_vol_14", "rsi_14", "ma_10_rel", "bb_upper_rel", "atr_14_rel", "volume_rel_30"]
    a, b = (features.build(x).orderBy("open_time").select(*names).collect() for x in (bars, scaled))
    for x, y in zip(a, b, strict=True):
        assert all((u is None and v is None) or abs(u - v) < 1e-6 * max(1, abs(u)) for u, v in zip(x, y, strict=True))


def test_without_the_other_part(tmp_path):
    """In a copy without the training-data part the rest is imported and registers its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root, copy = Path(__file__).resolve().parents[1], tmp_path / "copy"
    shutil.copytree(root / "tidemark", copy / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", copy)
    assert not (copy / "tidemark" / "llm").exists() and not (copy / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"} | {k: v for k, v in os.environ.items() if k.startswith(("PY", "JAVA", "SPARK", "HOME", "PATH"))})
