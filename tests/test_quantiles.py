"""Expanding quantiles against their definition, over chunks smaller and larger than the history."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecasts, quantiles

PROBS = [0.25, 0.5, 0.9]


def brute(values):
    seen, out = [], []
    for v in values:
        n = len(seen)
        out.append((n, *(float(np.quantile(seen, q)) if n else None for q in PROBS)))
        if v is not None and not math.isnan(v):
            seen.append(v)
    return out


@pytest.mark.parametrize("kind", ["drift", "ties", "nulls", "jump", "few"])
@pytest.mark.parametrize("size", [None, 7, 40])
def test_expanding_quantiles_equal_their_definition(spark, kind, size):
    rng = np.random.default_rng(len(kind))
    n = 3 if kind == "few" else 400
    values = {
        "drift": lambda: (np.arange(n) * 0.01 + rng.normal(0, 1, n)).tolist(), "ties": lambda: rng.choice([0.1, 0.2, 0.3], n, p=[0.8, 0.1, 0.1]).tolist(),
        "nulls": lambda: [None if i % 3 == 0 or i < 20 else float("nan") if i % 7 == 0 else float(x) for i, x in enumerate(rng.random(n))],
        "jump": lambda: np.concatenate([rng.random(n // 2), 100 - rng.random(n - n // 2)]).tolist(), "few": lambda: [0.3, 0.1, 0.2],
    }[kind]()
    rows = [("a", i, v) for i, v in enumerate(values)] + [("b", i, v) for i, v in enumerate(reversed(values))] + [("one", 0, 0.5)]
    got = quantiles.expanding(spark.createDataFrame(rows, "k string, pos long, x double").repartition(3), ["k"], "x", PROBS, size).orderBy("k", "pos").collect()
    for key, series in (("a", values), ("b", values[::-1]), ("one", [0.5])):
        mine = [r for r in got if r["k"] == key]
        for r, want in zip(mine, brute(series), strict=True):
            assert r["history"] == want[0] and all(x is y is None or abs(x - y) < 1e-12 for x, y in zip((r["q_0"], r["q_1"], r["q_2"]), want[1:], strict=True))


def test_no_rows(spark):
    assert quantiles.expanding(spark.createDataFrame([], "k string, pos long, x double"), ["k"], "x", PROBS).count() == 0


def test_long_histories_equal_percentiles_and_hold_no_series(spark):
    """50,000 bars of one series, by chunks, against the exact percentile of every thousandth prefix."""
    values = np.random.default_rng(1).beta(2, 5, 50_000).round(4)
    rows = spark.range(50_000).select(F.lit("s").alias("k"), F.col("id").alias("pos"), F.element_at(F.array(*[F.lit(float(v)) for v in values[:200]]), (F.col("id") % 200 + 1).cast("int")).alias("x"))
    rows = rows.withColumn("x", F.col("x") + F.rand(3) * 0.1)
    rows = spark.createDataFrame(rows.toPandas())
    out = quantiles.expanding(rows, ["k"], "x", PROBS)
    held = rows.orderBy("pos").toPandas()["x"].to_numpy()
    got = out.where("pos % 997 = 0").orderBy("pos").toPandas()
    want = np.stack([np.quantile(held[:p], PROBS) for p in got["pos"] if p])
    assert np.abs(got[["q_0", "q_1", "q_2"]].to_numpy()[1:] - want).max() < 1e-12 and got["history"].tolist() == got["pos"].tolist()


def test_grading_has_no_window_over_a_series(spark):
    rows = spark.createDataFrame([("s", "1d", "week", i, 0.2, float(i % 17) / 17, 0.01) for i in range(300)], "symbol string, interval string, horizon string, idx long, edge double, risk double, expected double")
    plan = forecasts.graded(rows, forecasts.HKEYS, "idx")._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((.*?) ASC", plan)
    assert specs and all("bucket" in x or "part" in x for x in specs)


@pytest.mark.parametrize("n", [1, 2, 5, 3001])
def test_quantiles_of_whole_groups(spark, n):
    rng = np.random.default_rng(n)
    values = {"plain": rng.normal(0, 1, n), "ties": rng.choice([1.0, 2.0, 3.0], n), "floor": np.where(rng.random(n) < 0.7, -1.0, rng.random(n))}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x], "k string, x double")
    for q in (0.0, 0.5, 0.93, 1.0):
        got = {r["k"]: r["m"] for r in quantiles.whole(rows, ["k"], "x", q, "m").collect()}
        assert all(abs(got[k] - np.quantile(x, q)) < 1e-12 for k, x in values.items())
