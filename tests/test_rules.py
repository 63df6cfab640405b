"""Rules of training, calibration, replay and study against brute force and hand values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import domain as d
from tidemark.operators import boosting, calibration, economics, forecasts, learning, series, significance, study

c = F.col


def test_window_widths(spark):
    rows = spark.createDataFrame([(7, 1400), (364, 2497), (364, 4000), (7, 60)], "f int, n int")
    assert [r[0] for r in rows.select(d.window_steps(c("f"), c("n"))).collect()] == [737, 1248, 1456, 37]
    history = spark.createDataFrame([("s", "year", 364, 900), ("s", "week", 7, 900)], "symbol string, horizon string, forward int, n int")
    got = {r["horizon"]: r for r in learning.resolve_windows(history, overrides={"year": 380}).collect()}
    assert (got["year"]["usable"], got["year"]["least_days"], got["week"]["steps"], got["week"]["usable"]) == (False, 395, 737, True)
    with pytest.raises(ValueError, match="year needs 395 days"):
        learning.resolve_windows(history, overrides={"year": 380}, strict=True)


def test_means_of_any_span(spark):
    """Spans from 1 to 5,000, with nulls, over chunks and groups of chunks shorter than the series: the plain recursion."""
    rng = np.random.default_rng(7)
    values = [None if rng.random() < 0.2 or i < 30 else float(x) for i, x in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 4000))))]
    rows = spark.createDataFrame([("s", "1d", i, x) for i, x in enumerate(values)] + [("none", "1d", 0, None)], "symbol string, interval string, idx long, x double")
    for size, wide in ((1024, 512), (50, 4)):
        spans = (1, 2, 3, 26, 400, 5000) if size == 50 else (2, 5000)
        chunks = series.chunked(rows, 20, 0, size)
        met = chunks.join(series.ewm_before(chunks, {f"b{n}": (c("x"), n) for n in spans}, wide=wide), ["symbol", "interval", "chunk"])
        got = series.done(met.withColumns({f"e{n}": series.ewm(c("x"), n, c(f"b{n}")) for n in spans})).where("symbol = 's'").orderBy("idx").collect()
        for n in spans:
            mean = None
            for r, x in zip(got, values, strict=True):
                if x is None:
                    assert r[f"e{n}"] is None
                else:
                    mean = x if mean is None else mean + 2 / (n + 1) * (x - mean)
                    assert abs(r[f"e{n}"] - mean) < 1e-9 * mean


def path_of(spark, marks, exposures):
    rows = [("s", "1d", "week", i, float(m), float(e)) for i, (m, e) in enumerate(zip(marks, exposures, strict=True))]
    return spark.createDataFrame(rows, "symbol string, interval string, horizon string, idx long, next_close double, exposure double").withColumn("next_open", c("next_close"))


def replayed(marks, exposures, cost):
    equity, held = 1.0, 0.0
    for i in range(len(marks) - 1):
        if marks[i] <= 0:
            continue
        equity *= 1 + exposures[i] * (marks[i + 1] / marks[i] - 1) - abs(exposures[i] - held) * cost
        held = exposures[i]
        if equity <= 0:
            return -1.0
    return equity - 1


def test_replay_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    for marks, exposures in (
        (np.exp(np.cumsum(rng.normal(0, 0.05, 60))).tolist(), rng.choice([0, 0.4, 1.0], 60).tolist()), ([10, 11, 0, 12, 13], [1, 1, 0, 0.5, 1]), ([10, 0, 5], [1, 1, 1]), ([5], [1]),
    ):
        got = forecasts.roi(forecasts.replay(path_of(spark, marks, exposures), 0.01)).first()
        assert abs(got["roi"] - replayed(marks, exposures, 0.01)) < 1e-9
    got = forecasts.roi(forecasts.replay(path_of(spark, [10, 11, 12], [0, 0, 1]), 0.01)).first()
    assert (got["turnover"], got["trades"], got["roi"]) == (0.0, 0, 0.0)  # the last bar's turnover is not paid


def test_shifts_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    marks, exposures = np.exp(np.cumsum(rng.normal(0, 0.03, 50))).tolist(), rng.choice([0, 0.2, 0.7, 1.0], 50).tolist()
    real = replayed(marks, exposures, 0.002)
    others = [replayed(marks, exposures[k:] + exposures[:k], 0.002) for k in range(1, 50)]
    for tile in (512, 7):
        monkeypatch.setattr(economics, "TILE", tile)
        got = economics.mistimed(path_of(spark, marks, exposures)).first()
        assert got["samples"] == 49 and abs(got["median_roi"] - np.median(others)) < 1e-9
        assert abs(got["percentile"] - 100 * sum(x < real for x in others) / 49) < 1e-9
        ruin = [3.0, 1.0, 2.0, 0.5, 1.0, 1.5, 0.1, 0.2]  # at twice the money some timings lose all of it
        held = [0.0, 2.0, 0.0, 2.0, 0.0, 0.0, 1.0, 0.0]
        others_ruined = [replayed(ruin, held[k:] + held[:k], 0.1) for k in range(8)]
        got = economics.mistimed(path_of(spark, ruin, held), 0.1).first()
        assert min(others_ruined) == -1.0 and abs(got["median_roi"] - np.median(others_ruined[1:])) < 1e-9 and abs(got["roi"] - others_ruined[0]) < 1e-9
    flat = economics.mistimed(path_of(spark, marks, [0.0] * 50)).first()
    assert flat["percentile"] == 50.0


def test_shifts_of_a_long_path(spark):
    """200,000 bars: any shift's sum is the plain sum over its steps."""
    rng = np.random.default_rng(4)
    r, e = rng.normal(0, 0.02, 199_999), rng.choice([0, 0.2, 0.4, 0.7, 1.0], 200_000)
    turn = np.round(np.abs(e - np.roll(e, 1)), 12)
    row = {"symbol": "s", "interval": "1m", "horizon": "week", "n": 200_000, "at": 0, "r": r, "start": 0, "e": e, "turn": turn}
    out = pd.concat(economics._shifted(0.002)([pd.DataFrame([row])])).groupby("shift")["growth"].sum()
    for k in (0, 1, 777, 199_999):
        moved, paid = np.roll(e, -k)[:-1], np.roll(turn, -k)[:-1]
        paid[0] = abs(moved[0])
        assert abs(out[k] - np.log(1 + r * moved - 0.002 * paid).sum()) < 1e-9


def test_constant_exposure_pays_once(spark):
    got = economics.constant_exposure(path_of(spark, [100, 150, 200], [0.5, 0.5, 0.5]), 0.01).first()
    assert abs(got["roi"] - (0.5 * 0.99 / 100 * 200 + 0.5 - 1)) < 1e-12


def test_temperatures(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.02, 0.98, 200)
    up = rng.random(200) < 0.5 + 0.1 * np.sign(p - 0.5)
    rows = [("a", float(x), bool(y)) for x, y in zip(p, up, strict=True)] + [("few", 0.9, k % 2 == 0) for k in range(39)] + [("one", 0.9, True)] * 60
    got = {r["k"]: r for r in calibration.fit_temperature(spark.createDataFrame(rows, "k string, p_long double, is_long boolean"), ["k"]).collect()}

    def loss(t):
        q = p ** (1 / t) / (p ** (1 / t) + (1 - p) ** (1 / t))
        return float(-np.log(np.where(up, q, 1 - q)).mean())

    assert got["a"]["temperature"] == min(d.TEMPERATURES, key=loss) and got["a"]["fitted_on"] == 200
    assert all((got[k]["temperature"], got[k]["fitted_on"]) == (1.0, 0) for k in ("few", "one"))
    fits = spark.createDataFrame([("w", 1, 1.0, 0), ("w", 2, 3.0, 90), ("w", 3, 1.0, 0), ("w", 4, 1.0, 50)], "k string, window int, temperature double, fitted_on long")
    used = [(r["temperature"], r["source"]) for r in calibration.temperature_memory(fits, ["k"], "window").orderBy("window").collect()]
    assert used == [(1000.0, "prior"), (3.0, "fitted"), (3.0, "carried"), (1.0, "fitted")]


def brute_split(slots, labels, purge):
    total = len(slots)
    held = int(total * 0.25)
    if held < 40:
        return total, total
    ends = lambda s: sum(x < slots[s] - purge for x in slots)
    due = slots.index(slots[total - held])
    if ends(due) <= 0:
        return total, total
    two = lambda x: len(set(x)) > 1
    if two(labels[: ends(due)]) and two(labels[due:]):
        return ends(due), due
    able = [s for s in range(1, total - 39) if slots[s - 1] < slots[s] and two(labels[: ends(s)]) and two(labels[s:])]
    best = min(able, key=lambda s: (abs(s - due), s), default=None)
    return (total, total) if best is None else (ends(best), best)


def test_splits_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    cases = {}
    for k, (n, share) in enumerate(((200, 0.5), (240, 0.02), (300, 0.98), (120, 0.5), (260, 0.0), (400, 0.01))):
        slots = sorted(rng.integers(0, max(n // 2, 1), n).tolist())
        cases[k] = (slots, ["long" if x else "short" for x in rng.random(n) < share])
    for k, (slots, labels) in cases.items():
        h = ["week", "month"][k % 2]
        by = {x: [y for z, y in zip(slots, labels, strict=True) if z == x] for x in sorted(set(slots))}
        df = spark.createDataFrame([("m", h, d.HORIZONS[h], x, len(y), y.count("long")) for x, y in by.items()], "month string, horizon string, forward int, slot long, n long, longs long")
        got = learning.holdouts(df).first()
        want = brute_split(slots, labels, d.HORIZONS[h])
        assert (got["fit_end"], got["held_from"]) == want, k
        if want[1] < len(slots):
            assert (sum(x < got["fit_before"] for x in slots), sum(x < got["held_slot"] for x in slots)) == want, k


def test_boosting_learns_and_does_not_look_ahead(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    x[::17, 2] = np.nan
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    predict, gains = boosting.boost(x[:400], y[:400], 50, 4, 0.1)
    assert ((predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9 and gains[:2].sum() > 0.8 * gains.sum()

    def run(late):
        close = [100 * math.exp(0.02 * math.sin(i * 0.9) + 0.01 * math.sin(i * 0.31)) * (late if i >= 640 else 1) for i in range(760)]
        rows = spark.createDataFrame([("s", "1d", i * 86400, z) for i, z in enumerate(close)], "symbol string, interval string, at long, close double").withColumn("open_time", F.timestamp_seconds("at")).drop("at")
        known = forecasts.labels(rows, {"week": 7})
        pool = known.withColumn("slot", learning.slot(c("open_time"))).withColumn("x", F.array(F.sin(c("idx") * 0.9), F.cos(c("idx") * 0.9), c("idx") % 5 * 1.0))
        plan = learning.plan(rows, {"week": 7}, days=400)
        return {r["open_time"]: r for r in learning.walk_forward(pool, ["a", "b", "e"], plan, (10, 3, 0.3)).collect()}

    one, two = run(1.0), run(3.0)
    months = sorted({r["month"] for r in one.values()})
    before = [m for m in months if m.timestamp() <= 640 * 86400]  # fitted on bars before the change
    assert len(one) == 760 and sum(r["trained"] for r in one.values()) > 500
    assert all(one[t]["raw_long"] == two[t]["raw_long"] for t in one if one[t]["month"] in before)
    late = [r for t, r in one.items() if r["trained"] and r["month"] > months[6]]
    assert all(abs(r["p_long"] + r["p_short"] - 1) < 1e-12 for r in late) and not one[min(one)]["trained"] and one[min(one)]["p_long"] == 0.5


def brute_tree(b, g, h, depth, least=boosting.LEAST):
    """Column, cut and gain of every node of one tree, row by row."""
    out, nodes = [], [np.arange(len(b))]
    for _ in range(depth):
        below = []
        for rows in nodes:
            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
            best = max(
                ((worth(left) + worth(right) - worth(rows), -column, -cut, left, right) for column in range(b.shape[1]) for cut in range(boosting.BINS)
                 if len(left := rows[b[rows, column] <= cut]) >= least and len(right := rows[b[rows, column] > cut]) >= least), key=lambda x: (round(x[0], 6), *x[1:3]), default=None)
            if best is None or best[0] <= 1e-9:
                out.append(None)
                below += [rows, rows[:0]]
            else:
                out.append((-best[1], -best[2], best[0]))
                below += best[3:]
        nodes = below
    return out


def test_splits_of_a_tree_are_the_best_there_are():
    rng = np.random.default_rng(6)
    b = rng.integers(0, 12, (300, 3)).astype(np.uint8)
    y = ((b[:, 0] > 5) ^ (b[:, 2] > 3)).astype(np.int64)
    forest = boosting.grown(b, y, np.bincount(y), 1, 3, 0.1)
    p = np.full(300, y.mean())
    want = brute_tree(b, p - y, p * (1 - p), 3)
    got = [(int(column), int(cut)) for columns, cuts in forest["trees"][0][0] for column, cut in zip(columns, cuts, strict=True)]
    assert [g if g[1] < boosting.BINS else None for g in got] == [w and w[:2] for w in want]
    assert abs(forest["gain"].sum() - sum(w[2] for w in want if w)) < 1e-3


@pytest.mark.parametrize("classes", [2, 4])
def test_models_over_many_tasks_are_those_of_one(spark, monkeypatch, classes):
    """Pieces of 64 rows and scores kept every second tree: the same trees, gains and leaves."""
    monkeypatch.setattr(boosting, "PIECE_ROWS", 64)
    monkeypatch.setattr(boosting, "KEPT_EVERY", 2)
    rng = np.random.default_rng(classes)
    rows, want = [], {}
    for model in ("a", "b"):
        b = rng.integers(0, 64, (700, 5)).astype(np.uint8)
        y = (b[:, 1].astype(int) // (64 // classes) + rng.integers(0, 2, 700)) % classes
        want[model] = boosting.grown(b, y, np.bincount(y), 5, 3, 0.3)
        rows += [(model, f"s{i % 7}", i, int(k), r.tobytes()) for i, (r, k) in enumerate(zip(b, y, strict=True))]
    df = spark.createDataFrame(rows, "model string, symbol string, open_time long, y int, bins binary").repartition(5)
    got = boosting.grown_over(df, 5, 3, 0.3, single=classes == 2)
    for model, forest in want.items():
        assert np.array_equal(got[model]["base"], forest["base"]) and np.allclose(got[model]["gain"], forest["gain"])
        for (levels, value), (other, leaf) in zip(forest["trees"], got[model]["trees"], strict=True):
            assert all(np.array_equal(x, y) for one, two in zip(levels, other, strict=True) for x, y in zip(one, two, strict=True)) and np.array_equal(value, leaf)


@pytest.mark.parametrize("classes", [2, 10])
def test_smaller_children_are_added_up(monkeypatch, classes):
    """Below the first level at most half the rows are added up, and trees, leaves and gains are those of all rows, bit by bit."""
    rng = np.random.default_rng(classes)
    b = rng.integers(0, 64, (500, 6)).astype(np.uint8)
    y = (b[:, 1].astype(int) // 4 + rng.integers(0, 3, 500)) % classes
    seen, histogram = [], boosting.histogram
    monkeypatch.setattr(boosting, "histogram", lambda b, *a: seen.append(len(b)) or histogram(b, *a))
    forest = boosting.grown(b, y, np.bincount(y, minlength=classes), 8, 4, 0.3)
    assert len(seen) == 32 and all(n <= (500 if k % 4 == 0 else 250) for k, n in enumerate(seen))
    score, gain = np.tile(forest["base"], (500, 1)), np.zeros(6)
    for levels, leaf in forest["trees"]:
        values, node = boosting.gradients(score, y), np.zeros(500, np.int64)
        for k, (column, cut) in enumerate(levels):
            best, at, won, children = boosting.split(histogram(b, values, node, 1 << k))
            assert np.array_equal(best, column) and np.array_equal(at, cut)
            np.add.at(gain, best, won)
            node = 2 * node + (b[np.arange(500), column[node]] > cut[node])
        assert np.array_equal(leaf, 0.3 * boosting.leaves(children))
        score += leaf[node]
    assert np.array_equal(gain, forest["gain"])


def test_a_run_is_the_same_with_large_models(spark, monkeypatch):
    """Both learners over a pool of two symbols, every model in one task and every model over all tasks."""
    rng = np.random.default_rng(9)
    rows = [(f"s{k}", i, "week", 7, *(("long", int(rng.integers(0, 3))) if (r := rng.random()) < 0.5 else ("short", 1)), [r, float(rng.random()), float(i % 5)]) for k in range(2) for i in range(300)]
    pool = spark.createDataFrame(rows, "symbol string, slot long, horizon string, forward int, direction string, depth_bin int, x array<double>").withColumn("open_time", F.timestamp_seconds(c("slot") * 86400))
    plan = learning.plan(pool.select("open_time"), {"week": 7}, days=120)
    told = lambda: [sorted((tuple(r) for r in x.collect()), key=str) for x in (learning.fitted(pool, ["a", "b", "e"], plan, (3, 2, 0.3)).drop("symbol", "open_time"), learning.depth_model(pool, plan, (2, 2, 0.3)))]
    near = told()
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    assert near == told() and {r[2] for r in near[0]} == {"held", "score", "gain"}


def test_only_rows_of_planned_models_are_dealt(spark, monkeypatch):
    """A plan of the last month: rows of months that it has no use for stay where they are, the rest as with all months; partitions are bounded by groups."""
    rng = np.random.default_rng(5)
    rows = [("s", i, "week", 7, None if r < 0.1 else "long" if r < 0.5 else "short", 1, [r, float("nan") if i % 7 == 0 else float(i % 5)]) for i in range(400) for r in [float(rng.random())]]
    pool = spark.createDataFrame(rows, "symbol string, slot long, horizon string, forward int, direction string, depth_bin int, x array<double>").withColumn("open_time", F.timestamp_seconds(c("slot") * 86400))
    plan = learning.plan(pool.select("open_time"), {"week": 7}, days=240)
    last = plan.where(c("month") == F.lit(plan.agg(F.max("month")).first()[0]))
    seen, dealt = [], learning.dealt

    def counted(df, *keys, **more):
        spark.conf.set("spark.sql.shuffle.partitions", 100)
        out = dealt(df, *keys, **more)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        seen.append((df.select(learning.month_of(c("slot"))).distinct().count(), out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(learning, "dealt", counted)
    told = lambda p, at: sorted((tuple(r) for r in learning.sliced(pool, p, learning.holdouts(learning.days(pool, p))).join(at.select("month"), "month", "left_semi").collect()), key=str)
    every, one = told(plan, last), told(last, last)
    assert every == one and {r[2] for r in one} == {"fit", "held", "score"}
    assert [n for n, _ in seen] == [14, 9] and all(parts == 64 for _, parts in seen)


def test_rows_that_symbols_give(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(i), "week", "long" if rng.random() < 0.8 else None) for s in ("a", "b") for i in range(200) if rng.random() < 0.7 or s == "a"]
    pool = spark.createDataFrame(rows, "symbol string, slot long, horizon string, direction string")
    plan = spark.createDataFrame([(m, "week", m * 30, 7, 60) for m in range(1, 8)], "month int, horizon string, cutoff long, forward int, steps int")
    got = {(r["month"], r["symbol"]): r["rows"] for r in learning.contributions(pool, plan).collect()}
    want = {(m, s): sum(x[0] == s and x[3] is not None and m * 30 - 60 <= x[1] < m * 30 - 7 for x in rows) for m in range(1, 8) for s in ("a", "b")}
    assert got == {k: n for k, n in want.items() if n}


def test_depths_fall_back_to_shares(spark):
    rows = [("s", i, "week", 7, "long" if i % 2 else "short", 3 if i % 2 else i % 3, [float(i % 4)]) for i in range(400)]
    pool = spark.createDataFrame(rows, "symbol string, slot long, horizon string, forward int, direction string, depth_bin int, x array<double>").withColumn("open_time", F.timestamp_seconds(c("slot") * 86400))
    plan = learning.plan(pool.select("open_time"), {"week": 7}, days=200)
    got = learning.depth_model(pool, plan, (5, 2, 0.3)).where("month = timestamp '1970-10-01'").collect()
    long, short = ([r for r in got if r["side"] == s] for s in ("long", "short"))
    assert all(not r["modelled"] and r["bins"][3] == 1.0 for r in long) and all(r["modelled"] and abs(sum(r["bins"]) - 1) < 1e-9 and sum(r["bins"][:3]) > 0.999 for r in short)


def test_policies_and_names():
    assert d.exposure_policy("buy=0.5, Strong-Sell=0.1")["Buy"] == 0.5 and d.exposure_policy(None) == d.EXPOSURE
    for bad in ("hold=1", "buy", "nope=1", "buy=1.5"):
        with pytest.raises(ValueError):
            d.exposure_policy(bad)


def test_runs_are_found_or_named(spark):
    runs = spark.createDataFrame([("A", "m", "1d", "20240101T000000", "m_1d_20240101T000000"), ("A", "m", "1d", "20240301T000000", "m_1d_20240301T000000")], "symbol string, model string, interval string, run_ts string, slug string")
    assert forecasts.resolve(runs, "A").first()["run_ts"] == "20240301T000000"
    with pytest.raises(ValueError, match="m_1d_20240301T000000, m_1d_20240101T000000"):
        forecasts.resolve(runs, "A", "other")
    rows = spark.createDataFrame([("decade",)], "horizon string")
    with pytest.raises(ValueError, match="decade"):
        forecasts.known_horizons(rows)


def test_departures_draw_survivors_again(spark):
    rng = np.random.default_rng(4)
    rows = [("s", m, 1, "week", 7, i, float(x)) for m, p in (("good", 0.75), ("coin", 0.5)) for i, x in enumerate(rng.random(700) < p)]
    df = spark.createDataFrame(rows, "symbol string, model string, seed int, horizon string, forward int, pos long, x double")
    got = {r["model"]: r for r in significance.departures(df, study.RUN, 400, 1000).collect()}
    assert got["good"]["p_precise"] < 0.01 and got["good"]["q_precise"] < 0.05 and got["good"]["p_double_block"] is not None
    assert got["coin"]["q_value"] > 0.05 and got["coin"]["p_precise"] is None


def test_block_sums_reach_the_draws_either_way(spark, monkeypatch):
    rows = [("A", 3, i, float(i % 2)) for i in range(60)] + [("N", 7, i, float(i % 3 == 0)) for i in range(75)] + [("R", 30, i, 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, forward int, pos long, x double")
    told = lambda: sorted(map(tuple, significance.resampled(df, ["symbol"], ["x"], 50).select("symbol", "b", "n", "x").collect()))
    near = told()
    monkeypatch.setattr(significance, "LOOKUP_VALUES", 0)
    assert near == told()
    assert len(near) == 100 and {r[0] for r in near} == {"A", "N"}  # R has fewer than ten blocks
