"""Forward labels, the windowed frequency forecast, its evaluation and the decisions built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain as d
from ..sources.tables import settled
from . import quantiles
from .series import beside, carried, chunked, done, indexed, numbered, over

c = F.col
HKEYS = ["symbol", "interval", "horizon"]


def labels(bars: DataFrame, horizons: dict[str, int] = d.HORIZONS) -> DataFrame:
    """Long labels: symbol, interval, open_time, idx, close, horizon, forward, fwd_return, direction, depth_bin (number), target_time.

    A label is unknown when the horizon passes the end or a price is missing, not a number or zero; a return of exactly
    zero has no direction and no bin.
    """
    rows = chunked(indexed(bars.select("symbol", "interval", "open_time", "close")), 0, max(horizons.values()))
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("forward"), F.lead("close", k).over(over()).alias("later"), F.lead("open_time", k).over(over()).alias("target_time")) for h, k in horizons.items()])
    rows = done(rows.withColumn("ahead", ahead)).withColumn("a", F.explode("ahead"))
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (x != 0)
    rows = rows.select("symbol", "interval", "open_time", "idx", "close", "a.*")
    r = F.when(usable(c("close")) & usable(c("later")), c("later") / c("close") - 1)
    rows = rows.withColumn("fwd_return", r).drop("later")
    return rows.withColumns({"direction": d.direction(c("fwd_return")), "depth_bin": F.when(c("fwd_return") != 0, d.depth_index(F.abs("fwd_return") * 100))})


def label_distribution(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("symbol", "horizon").agg(F.count("direction").alias("labelled"), F.count_if(c("direction") == "long").alias("longs"), F.count_if(c("direction") == "short").alias("shorts"))
    return out.withColumn("long_share", F.try_divide(c("longs").cast("double"), c("labelled")))


def default_window(forward: int) -> int:
    return forward + max(730, 3 * forward)


def counted(rows: DataFrame, horizons: dict[str, int] = d.HORIZONS, windows: dict[str, int] | None = None) -> DataFrame:
    """Labels with n_up, n_down (counts by depth bin), longs, shorts and known of the labels known before each bar: bars i-W .. i-F-1.

    Counts are running sums inside a chunk, read twice by lag, so a row costs the same whatever the window.
    """
    windows = windows or {h: default_window(k) for h, k in horizons.items()}
    rows = chunked(rows, max(windows.values()) + 1, 0, 4 * max(windows.values()))
    w = over(keys=HKEYS)
    upto = over(Window.unboundedPreceding, 0, HKEYS)
    hits = [F.sum(F.when((c("direction") == side) & (c("depth_bin") == k), 1).otherwise(0)).over(upto) for side in ("long", "short") for k in range(len(d.DEPTH_BINS))]
    rows = rows.withColumn("sums", F.array(*hits))
    zero = F.array_repeat(F.lit(0).cast("long"), len(hits))
    counts = None
    for h, forward in horizons.items():
        here = F.zip_with(F.coalesce(F.lag("sums", forward + 1).over(w), zero), F.coalesce(F.lag("sums", windows[h] + 1).over(w), zero), lambda a, b: a - b)
        counts = F.when(c("horizon") == h, here) if counts is None else counts.when(c("horizon") == h, here)
    rows = done(rows.withColumn("n", counts)).drop("sums")
    k = len(d.DEPTH_BINS)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    rows = rows.withColumns({"n_up": F.slice("n", 1, k), "n_down": F.slice("n", k + 1, k)}).drop("n")
    return rows.withColumns({"longs": total(c("n_up")), "shorts": total(c("n_down"))}).withColumn("known", c("longs") + c("shorts"))


def smoothed(counts: DataFrame, alpha: float | Column = 1.0, also: tuple[str, ...] = ()) -> DataFrame:
    """The frequency forecast from counts; alpha may be a column, so that many forecasts come from one count."""
    k = len(d.DEPTH_BINS)
    trained = c("known") >= d.MIN_TRAIN
    bins = lambda a, n: F.transform(a, lambda x: d.laplace(x, n, k, alpha))
    return counts.select(
        *HKEYS, *also, "open_time", "idx", "close", "forward", "fwd_return", "direction", "depth_bin", "target_time", trained.alias("trained"), "known",
        F.when(trained, d.laplace(c("longs"), c("known"), 2, alpha)).alias("p_long"), F.when(trained, d.laplace(c("shorts"), c("known"), 2, alpha)).alias("p_short"),
        F.when(trained, bins(c("n_up"), c("longs"))).alias("up"), F.when(trained, bins(c("n_down"), c("shorts"))).alias("down"),
    )


def baseline(rows: DataFrame, alpha: float = 1.0, horizons: dict[str, int] = d.HORIZONS, windows: dict[str, int] | None = None) -> DataFrame:
    """The frequency forecast of every bar and horizon from labels known before it."""
    return smoothed(counted(rows, horizons, windows), alpha)


def several(rows: DataFrame, runs: list[tuple[str, int, float]]) -> DataFrame:
    """Forecasts of several runs (model, seed, alpha) from one count of the labels."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"), F.lit(float(a)).alias("alpha")) for m, s, a in runs])
    counts = counted(rows).withColumn("run", F.explode(each)).withColumns({"model": c("run.model"), "seed": c("run.seed")})
    return smoothed(counts, c("run.alpha"), ("model", "seed"))


def scored(forecasts: DataFrame) -> DataFrame:
    """The quality row of every trained forecast: status, scores, depth errors, flags and the reason in words."""
    rows = forecasts.where("trained")
    is_long = c("p_long") >= c("p_short")
    rows = rows.withColumns({"predicted": F.when(is_long, "long").otherwise("short"), "confidence": F.greatest("p_long", "p_short"), "entropy": d.entropy(F.array("p_long", "p_short"))})
    rows = rows.withColumn("side", F.when(is_long, c("up")).otherwise(c("down")))
    status = F.when(c("fwd_return").isNull(), "missing_target").when(c("direction").isNull(), "unclassifiable_outcome").otherwise("scored")
    rows = rows.withColumns({"status": status, "predicted_bin": d.argmax(c("side")), "predicted_depth": d.expected_depth(c("side"))})
    ok = c("status") == "scored"
    actual = F.transform(F.sequence(F.lit(0), F.lit(len(d.DEPTH_BINS) - 1)), lambda k: F.when(k == c("depth_bin"), 1.0).otherwise(0.0))
    rows = rows.withColumns({
        "correct": F.when(ok, c("predicted") == c("direction")), "brier": F.when(ok, d.brier(c("p_long"), c("p_short"), c("direction") == "long")),
        "nll": F.when(ok, d.nll(F.when(c("direction") == "long", c("p_long")).otherwise(c("p_short")))),
        "depth_kl": F.when(ok, d.kl(actual, c("side"))), "depth_js": F.when(ok, d.js(actual, c("side"))), "depth_abs_error_pct": F.when(ok, F.abs(c("predicted_depth") - F.abs("fwd_return") * 100)),
    })
    rows = rows.withColumn("quality_score", F.when(ok, d.quality_score(c("correct"), c("confidence"), c("brier"), c("nll"), c("depth_abs_error_pct"))))
    flags = d.quality_flags(c("correct"), c("confidence"), c("entropy"), c("depth_abs_error_pct"), c("predicted_bin"), c("depth_bin"))
    reason = d.quality_reason(c("status"), c("correct"), c("predicted"), c("direction"), c("confidence"), c("fwd_return"))
    return rows.withColumns({"error_score": 100 - c("quality_score"), "flags": F.when(ok, flags), "reason": reason}).drop("side")


def calibration_curve(quality: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    rows = quality.where("status = 'scored'").withColumn("bin", F.least(F.lit(bins - 1), F.floor(c("confidence") * bins)).cast("int"))
    got = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(c("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    grid = got.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(got, [*keys, "bin"], "left").fillna({"n": 0, "accuracy": 0.0, "mean_confidence": 0.0})
    return out.withColumn("gap", F.abs(c("accuracy") - c("mean_confidence")))


def ece(quality: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    curve = calibration_curve(quality, keys, bins)
    return curve.groupBy(*keys).agg((F.sum(c("n") * c("gap")) / F.sum("n")).alias("ece"))


def metrics(quality: DataFrame, keys: list[str]) -> DataFrame:
    ok = quality.where("status = 'scored'")
    err = c("depth_abs_error_pct")
    out = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(c("correct").cast("double")).alias("accuracy"), F.avg("brier").alias("brier"), F.avg("nll").alias("nll"), F.avg("entropy").alias("entropy"),
        F.avg("confidence").alias("confidence"), F.avg("depth_kl").alias("depth_kl"), F.avg("depth_js").alias("depth_js"), F.avg(err).alias("depth_mae"), F.sqrt(F.avg(err * err)).alias("depth_rmse"), F.avg("quality_score").alias("score"),
    )
    return out.join(ece(quality, keys), keys)


def signals(forecasts: DataFrame) -> DataFrame:
    """edge, risk and expected move of every trained forecast."""
    return forecasts.where("trained").withColumns({"edge": d.edge(c("p_long"), c("p_short")), "risk": d.risk(c("p_long"), c("p_short"), c("up"), c("down")), "expected": d.expected_move(c("p_long"), c("p_short"), c("up"), c("down"))})


def graded(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Gates from strictly earlier risks, and the verdict, of rows with edge, risk and expected move; order is a whole number."""
    rows = settled(numbered(rows, keys, order, "__at"))
    gates = quantiles.expanding(rows.withColumnRenamed("__at", "pos").select(*keys, "pos", "risk"), keys, "risk", list(d.QUANTILES)).withColumnRenamed("pos", "__at")
    rows = rows.join(gates, [*keys, "__at"]).drop("__at")
    known = [F.when(c("history") >= d.LEAST_HISTORY, c(f"q_{k}")).otherwise(F.lit(g)) for k, g in enumerate(d.STATIC_GATES)]
    rows = rows.withColumns({f"gate_{k}": g for k, g in enumerate(known)}).drop(*[f"q_{k}" for k in range(len(d.QUANTILES))])
    return rows.withColumn("verdict", d.recommendation(c("edge"), c("risk"), F.abs("expected") > d.ROUND_TRIP_COST, [c(f"gate_{k}") for k in range(3)]))


def decisions(forecasts: DataFrame) -> DataFrame:
    return graded(signals(forecasts), HKEYS, "idx")


def exposure(decided: DataFrame, policy: dict[str, float] | None = None) -> DataFrame:
    """Target share of each verdict, held through Hold, 0 before the first signal."""
    shares = F.create_map(*[F.lit(x) for k, v in (policy or d.EXPOSURE).items() for x in (k, v)])
    rows = carried(decided, "last", {"exposure": F.try_element_at(shares, c("verdict"))}, HKEYS, "idx")
    return rows.withColumn("exposure", F.coalesce("exposure", F.lit(0.0)))


def weekly_windows(forecasts: DataFrame) -> DataFrame:
    rows = signals(forecasts)
    out = rows.groupBy(*HKEYS, F.date_trunc("week", "open_time").alias("monday")).agg(F.avg("edge").alias("edge"), F.avg("risk").alias("risk"), F.avg("expected").alias("expected"), F.count(F.lit(1)).alias("bars"))
    return out.withColumn("sunday", F.date_add("monday", 6))


def plan_windows(forecasts: DataFrame) -> DataFrame:
    """Weekly windows graded in order by gates from the risks of earlier weeks, with the month of their Monday."""
    weeks = weekly_windows(forecasts).withColumn("week", F.floor(F.unix_seconds("monday") / 604800))
    return graded(weeks, HKEYS, "week").drop("week").withColumns({"month": F.date_format("monday", "yyyy-MM"), "cost_cleared": F.abs("expected") > d.ROUND_TRIP_COST})


def replay(path: DataFrame, cost: float = 0.002, keys: list[str] = HKEYS, price: str = "next_close", order: str = "idx") -> DataFrame:
    """path with pos, turn and f: exposure i is held into the price after the next, f = 1 + e_i r_(i+1) - |e_i - e_(i-1)| cost.

    The last bar has no return: its f is null and its turnover is not paid. Bars with a price of 0 are passed over.
    """
    rows = beside(numbered(path, keys, order), {"later": lambda w: F.lead(price).over(w)}, keys, ahead=1)
    rows = numbered(rows.where(c(price) > 0).drop("pos"), keys, order)
    rows = beside(rows, {"held": lambda w: F.coalesce(F.lag("exposure").over(w), F.lit(0.0))}, keys, back=1)
    rows = rows.withColumn("turn", F.when(c("later").isNotNull(), F.abs(c("exposure") - c("held"))))
    return rows.withColumn("f", 1 + c("exposure") * (c("later") / c(price) - 1) - c("turn") * cost).drop("later", "held")


def growth(f: Column) -> Column:
    """Logarithm of a step's growth; a ruined path stays far below any other, and a bar without a step has none."""
    return F.when(f.isNotNull(), F.ln(F.greatest(f, F.lit(1e-300))))


def roi(rows: DataFrame, keys: list[str] = HKEYS) -> DataFrame:
    """Return of replayed paths; -1 once a step takes all."""
    value = F.when(F.min("f") <= 0, -1.0).otherwise(F.exp(F.coalesce(F.sum(growth(c("f"))), F.lit(0.0))) - 1)
    return rows.groupBy(*keys).agg(value.alias("roi"), F.avg("exposure").alias("mean_exposure"), F.coalesce(F.sum("turn"), F.lit(0.0)).alias("turnover"), F.count_if(c("turn") > 0).alias("trades"), F.count(F.lit(1)).alias("bars"))


def stability(quality: DataFrame, horizons: dict[str, int] = d.HORIZONS) -> DataFrame:
    """Per symbol, month and horizon: samples and mean scores, sparse below five; a month that lacks a horizon has a row of nulls for it."""
    by = quality.where("status = 'scored'").groupBy("symbol", "horizon", F.date_trunc("month", "open_time").alias("month")).agg(F.count(F.lit(1)).alias("samples"), F.avg("nll").alias("logloss"), F.avg("brier").alias("brier"), F.avg(c("correct").cast("double")).alias("accuracy"))
    grid = by.select("symbol", "month").distinct().withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    out = grid.join(by, ["symbol", "month", "horizon"], "left").fillna({"samples": 0})
    return out.withColumn("sparse", c("samples") < 5)


def one_month(rows: DataFrame, month: str, limit: int = 5000) -> DataFrame:
    """Rows of a calendar month (YYYY-MM), the first `limit` (1 to 5000) in time order, with how many matched and whether some are left out."""
    found = rows.where(F.date_format("open_time", "yyyy-MM") == month)
    n = found.agg(F.count(F.lit(1)).alias("matched"))
    limit = max(1, min(limit, 5000))
    return found.orderBy("open_time", "symbol", "horizon").limit(limit).crossJoin(F.broadcast(n)).withColumn("truncated", c("matched") > limit)  # one row


def known_horizons(rows: DataFrame, horizons: dict[str, int] = d.HORIZONS) -> DataFrame:
    """The rows of horizons that this build knows; raises where there are rows and none is known."""
    known = rows.where(c("horizon").isin(list(horizons)))
    if known.isEmpty() and not rows.isEmpty():
        there = [r["horizon"] for r in rows.select("horizon").distinct().orderBy("horizon").limit(20).collect()]
        raise ValueError(f"no known horizon among {', '.join(map(str, there))}; known are {', '.join(horizons)}")
    return known


def snapshots(quality: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """quality with feat_ columns: the features of the first bar of the forecast's date, finite values only."""
    w = Window.partitionBy("symbol", "date").orderBy("open_time")
    finite = lambda n: F.when(F.abs(n) < float("inf"), c(n)).alias(f"feat_{n}")
    first = features.withColumn("date", F.to_date("open_time")).withColumn("k", F.row_number().over(w)).where("k = 1")
    return quality.withColumn("date", F.to_date("open_time")).join(first.select("symbol", "date", *map(finite, names)), ["symbol", "date"], "left").drop("date")


def recommendations(rows: DataFrame, limit: int = 500) -> DataFrame:
    """The best scored rows by quality score, then by edge, with whether some are left out."""
    ok = rows.where("status = 'scored'").withColumn("edge", d.edge(c("p_long"), c("p_short")))
    n = ok.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return ok.orderBy(c("quality_score").desc(), F.round(F.abs("edge"), 9).desc(), "open_time", "horizon", "symbol").limit(limit).crossJoin(F.broadcast(n))  # one row


def worst(rows: DataFrame, limit: int = 100, flag: str | None = None) -> DataFrame:
    """The worst scored rows (1 to 5000, with a flag if one is named) by error score, with how many there are in all."""
    ok = rows.where("status = 'scored'")
    ok = ok.where(F.array_contains("flags", flag)) if flag else ok
    n = ok.agg(F.count(F.lit(1)).alias("total"))
    return ok.orderBy(c("error_score").desc(), "open_time", "horizon", "symbol").limit(max(1, min(limit, 5000))).crossJoin(F.broadcast(n))  # one row


def pooled_power(facts: DataFrame, correlations: DataFrame) -> DataFrame:
    """facts (horizon, forward, n times, scored rows) with effective symbols, independent observations to train on and to be scored on, and `low`: the sides with fewer than MIN_INDEPENDENT."""
    rows = facts.join(correlations.select("horizon", "symbols", "correlation"), "horizon")
    rows = rows.withColumn("effective", d.effective_symbols(c("symbols").cast("double"), c("correlation")))
    train = d.effective_samples(F.greatest(F.lit(0), d.window_steps(c("forward"), c("n")) - c("forward")), c("forward")) * F.greatest(F.lit(1.0), c("effective"))
    rows = rows.withColumns({"train_power": train, "scored_power": d.effective_samples(c("scored"), c("forward"))})
    return rows.withColumn("low", F.array_compact(F.array(F.when(c("train_power") < d.MIN_INDEPENDENT, "training window"), F.when(c("scored_power") < d.MIN_INDEPENDENT, "scored range"))))


def cutoffs(bars: DataFrame) -> DataFrame:
    """The first bar of each calendar month serves that month."""
    return bars.groupBy("symbol", F.date_trunc("month", "open_time").alias("month")).agg(F.min("open_time").alias("cutoff"))


def training_slice(rows: DataFrame, first: int) -> DataFrame:
    """Labelled rows of each (cutoff, horizon): cutoff - W <= bar < cutoff - F.

    Running counts by bar are looked up at the two ends of each window, so nothing is expanded by the range.
    """
    w = Window.partitionBy(*HKEYS, "part").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"part": F.floor(c("idx") / 4096), "known": c("direction").isNotNull().cast("long"), "up": F.coalesce((c("direction") == "long").cast("long"), F.lit(0))})
    sums = rows.groupBy(*HKEYS, "part").agg(F.sum("known").alias("k"), F.sum("up").alias("u"))
    before = Window.partitionBy(*HKEYS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*HKEYS, "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"), F.coalesce(F.sum("u").over(before), F.lit(0)).alias("u0"))
    run = rows.withColumns({"k1": F.sum("known").over(w), "u1": F.sum("up").over(w)}).join(starts, [*HKEYS, "part"])
    run = run.select("symbol", "horizon", "idx", "forward", "open_time", (c("k0") + c("k1")).alias("k"), (c("u0") + c("u1")).alias("u"))
    at = run.where(c("idx") >= first).groupBy("symbol", "horizon", "forward", F.date_trunc("month", "open_time").alias("month")).agg(F.min("idx").alias("at"))
    window = d.ideal_window(c("forward"))
    ends = at.select("symbol", "horizon", "at", (c("at") - c("forward") - 1).alias("idx"), (c("at") - window - 1).alias("low"))
    upper = ends.join(run.select("symbol", "horizon", "idx", "k", "u"), ["symbol", "horizon", "idx"]).drop("idx").withColumnRenamed("low", "idx")
    lower = run.select("symbol", "horizon", "idx", c("k").alias("k_low"), c("u").alias("u_low"))
    out = upper.join(lower, ["symbol", "horizon", "idx"], "left")
    return out.select("symbol", "horizon", "at", (c("k") - F.coalesce("k_low", F.lit(0))).alias("n"), (c("u") - F.coalesce("u_low", F.lit(0))).alias("longs"))


def match_bar(times: DataFrame, bars: DataFrame) -> DataFrame:
    """Each time with its bar: the one at that instant, else the first of its calendar date."""
    exact = bars.select("symbol", c("open_time").alias("at"), c("open_time").alias("t1"), c("close").alias("c1"))
    first = bars.groupBy("symbol", F.to_date("open_time").alias("day")).agg(F.min(F.struct("open_time", "close")).alias("f"))
    met = times.join(exact, ["symbol", "at"], "left").withColumn("day", F.to_date("at")).join(first, ["symbol", "day"], "left")
    return met.select("symbol", "at", F.coalesce("t1", "f.open_time").alias("bar_time"), F.coalesce("c1", "f.close").alias("close"))


def named_runs(forecasts: DataFrame) -> DataFrame:
    """The catalogue of stored forecasts (symbol, model, interval, run_ts): one row a run, with its slug, rows and span."""
    keys = ["symbol", "model", "interval", "run_ts"]
    out = forecasts.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    return out.withColumn("slug", F.concat_ws("_", "model", "interval", "run_ts"))


def resolve(runs: DataFrame, symbol: str, model: str | None = None, interval: str | None = None, run_ts: str | None = None) -> DataFrame:
    """The newest run that matches, or the named one; raises with the symbol's candidates where there is none."""
    found = runs.where(c("symbol") == symbol)
    for name, value in (("model", model), ("interval", interval), ("run_ts", run_ts)):
        found = found.where(c(name) == value) if value else found
    found = found.orderBy(c("run_ts").desc(), "model", "interval").limit(1)
    if found.isEmpty():
        near = [r["slug"] for r in runs.where(c("symbol") == symbol).orderBy(c("run_ts").desc(), "slug").limit(20).collect()]
        raise ValueError(f"no run of {symbol} for {model or 'any model'}, {interval or 'any interval'}, {run_ts or 'newest'}; there are: {', '.join(near) or 'none'}")
    return found
