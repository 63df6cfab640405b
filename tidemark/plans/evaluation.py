"""Registered queries over labels, forecasts, their evaluation, decisions, significance and economics, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain as d
from ..operators import calibration, correlation, economics, forecasts, learning, significance
from ..operators import quality as quality_checks
from ..operators.series import beside, numbered
from ..sources.tables import BARS, daily_bars, settled
from . import market
from .market import c, rounded, select

FOUND: dict = {}


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = (lambda spark, sf_dir: rounded(f(spark, sf_dir)), sql)
        return f

    return add


def labels(spark, sf_dir) -> DataFrame:
    return forecasts.labels(daily_bars(spark, sf_dir))


def baseline(spark, sf_dir, alpha: float = 1.0) -> DataFrame:
    return forecasts.baseline(labels(spark, sf_dir), alpha)


#: Two models (model, seed, smoothing), alike but for the smoothing.
TWO_RUNS = [("a1", 1, 1.0), ("a20", 1, 20.0)]


def two_models(spark, sf_dir) -> DataFrame:
    return forecasts.several(labels(spark, sf_dir), TWO_RUNS)


def quality(spark, sf_dir) -> DataFrame:
    return forecasts.scored(baseline(spark, sf_dir))


K = len(d.DEPTH_BINS)
BIN = "CASE " + " ".join(f"WHEN abs(fwd_return) * 100 >= {e} THEN {k}" for k, e in reversed(list(enumerate(d.DEPTH_EDGES)))) + " END"
LAB = (
    f"{BARS}, bi AS (SELECT symbol, open_time, open, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS idx FROM bars), l0 AS ("
    + " UNION ALL ".join(f"SELECT symbol, open_time, idx, close, '{h}' AS horizon, {k} AS forward, lead(open_time, {k}) OVER w AS target_time, lead(close, {k}) OVER w / close - 1 AS fwd_return FROM bi WINDOW w AS (PARTITION BY symbol ORDER BY idx)" for h, k in d.HORIZONS.items())
    + f"), lab AS (SELECT *, CASE WHEN fwd_return > 0 THEN 'long' WHEN fwd_return < 0 THEN 'short' END AS direction, CASE WHEN fwd_return <> 0 THEN {BIN} END AS depth_bin FROM l0)"
)


def _counts() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE direction = '{s}' AND depth_bin = {k}) OVER w AS {s}_{k}" for s in ("long", "short") for k in range(K))
    parts = " UNION ALL ".join(
        f"SELECT *, {counts} FROM lab WHERE horizon = '{h}' WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {forecasts.default_window(f)} PRECEDING AND {f + 1} PRECEDING)" for h, f in d.HORIZONS.items()
    )
    longs, shorts = (" + ".join(f"{s}_{k}" for k in range(K)) for s in ("long", "short"))
    return f"cn_c AS ({parts}), cn AS (SELECT *, {longs} AS longs, {shorts} AS shorts FROM cn_c)"


def _smoothed(name: str, source: str, alpha: str, also: str = "") -> str:
    bins = lambda s, n: "[" + ", ".join(f"({s}_{k} + {alpha}) / ({n} + {alpha} * {K})" for k in range(K)) + "]::double[]"
    trained = f"CASE WHEN longs + shorts >= {d.MIN_TRAIN} THEN"
    return f"""{name} AS (SELECT symbol, '1d' AS interval, horizon, {also} open_time, idx, close, forward, fwd_return, direction, depth_bin, target_time, longs + shorts AS known, longs + shorts >= {d.MIN_TRAIN} AS trained,
 {trained} ((longs + {alpha}) / (longs + shorts + 2 * {alpha}))::double END AS p_long, {trained} ((shorts + {alpha}) / (longs + shorts + 2 * {alpha}))::double END AS p_short,
 {trained} {bins('long', 'longs')} END AS up, {trained} {bins('short', 'shorts')} END AS down FROM {source})"""


def several(name: str, runs: list[tuple[str, int, float]]) -> str:
    """SQL of `forecasts.several`, after cn."""
    values = ", ".join(f"('{m}', {seed}, {a}::double)" for m, seed, a in runs)
    return f"{name}_r AS (SELECT cn.*, model, seed, alpha FROM cn CROSS JOIN (VALUES {values}) v(model, seed, alpha)), {_smoothed(name, f'{name}_r', 'alpha', 'model, seed,')}"


COUNTED = f"{LAB}, {_counts()}"
FC = f"{COUNTED}, {_smoothed('fc', 'cn', '1.0::double')}"
MIDS = "[" + ", ".join(map(str, d.MIDPOINTS)) + "]"
ORDS = "[" + ", ".join(map(str, range(K))) + "]"
FIRST_LARGE = next(k for k, e in enumerate(d.DEPTH_EDGES) if e >= d.LARGE_MOVE)


def kl(p: str, q: str) -> str:
    return f"list_sum(list_transform({ORDS}, lambda k: greatest(({p})[k + 1], 1e-12) * ln(greatest(({p})[k + 1], 1e-12) / greatest(({q})[k + 1], 1e-12))))"


def scored_sql(source: str, name: str) -> str:
    ln2, mid = "ln(2)", f"list_transform({ORDS}, lambda k: (actual[k + 1] + side[k + 1]) / 2)"
    return f"""{name}_1 AS (SELECT *, CASE WHEN p_long >= p_short THEN 'long' ELSE 'short' END AS predicted, greatest(p_long, p_short) AS confidence, -(p_long * ln(p_long) + p_short * ln(p_short)) AS entropy,
  CASE WHEN p_long >= p_short THEN up ELSE down END AS side, list_transform({ORDS}, lambda k: CASE WHEN k = depth_bin THEN 1.0 ELSE 0.0 END::double) AS actual,
  CASE WHEN fwd_return IS NULL THEN 'missing_target' WHEN direction IS NULL THEN 'unclassifiable_outcome' ELSE 'scored' END AS status FROM {source} WHERE trained),
{name}_2 AS (SELECT *, (list_position(side, list_max(side)) - 1)::int AS predicted_bin, list_sum(list_transform({ORDS}, lambda k: side[k + 1] * {MIDS}[k + 1])) AS predicted_depth,
  CASE WHEN status = 'scored' THEN predicted = direction END AS correct, CASE WHEN direction = 'long' THEN p_long ELSE p_short END AS p_true FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN status = 'scored' THEN 2 * (1 - p_true) * (1 - p_true) END AS brier, CASE WHEN status = 'scored' THEN -ln(greatest(p_true, 1e-12)) END AS nll,
  CASE WHEN status = 'scored' THEN {kl('actual', 'side')} END AS depth_kl, CASE WHEN status = 'scored' THEN ({kl('actual', mid)} + {kl('side', mid)}) / 2 END AS depth_js,
  CASE WHEN status = 'scored' THEN abs(predicted_depth - abs(fwd_return) * 100) END AS depth_abs_error_pct FROM {name}_2),
{name} AS (SELECT *, CASE WHEN status = 'scored' THEN round(least(100, CASE WHEN correct THEN 45.0 ELSE 0.0 END + 25 * greatest(0, 1 - brier / 2) + 20 * greatest(0, 1 - nll / {ln2})
  + 10 * CASE WHEN correct THEN confidence ELSE 1 - confidence END + 10 * greatest(0, 1 - depth_abs_error_pct / 20)), 4) END AS quality_score,
  CASE WHEN status = 'scored' THEN list_filter([CASE WHEN confidence < 0.45 THEN 'low_confidence' END, CASE WHEN entropy > 0.92 * {ln2} THEN 'high_entropy' END, CASE WHEN NOT correct AND confidence >= 0.65 THEN 'calibration_mismatch' END,
  CASE WHEN depth_abs_error_pct >= 5 THEN 'large_return_error' END, CASE WHEN predicted_bin <> depth_bin THEN 'depth_mismatch' END], lambda x: x IS NOT NULL) END AS flags, CASE status WHEN 'missing_target' THEN 'No bar yet at the horizon''s end.' WHEN 'scored' THEN printf('%s: said %s, came %s; %.1f%% sure, moved %.2f%%', CASE WHEN correct THEN 'correct' ELSE 'wrong' END, predicted, direction, confidence * 100, fwd_return * 100) END AS reason FROM {name}_3)"""


def lean_sql(source: str, name: str) -> str:
    """Of `scored_sql` what comparisons of runs need."""
    return f"""{name}_1 AS (SELECT *, CASE WHEN p_long >= p_short THEN 'long' ELSE 'short' END AS predicted, greatest(p_long, p_short) AS confidence,
  CASE WHEN fwd_return IS NULL THEN 'missing_target' WHEN direction IS NULL THEN 'unclassifiable_outcome' ELSE 'scored' END AS status, CASE WHEN direction = 'long' THEN p_long ELSE p_short END AS p_true FROM {source} WHERE trained),
{name} AS (SELECT *, CASE WHEN status = 'scored' THEN predicted = direction END AS correct, CASE WHEN status = 'scored' THEN 2 * (1 - p_true) * (1 - p_true) END AS brier, CASE WHEN status = 'scored' THEN -ln(greatest(p_true, 1e-12)) END AS nll FROM {name}_1)"""


QUALITY = f"{FC}, {scored_sql('fc', 'q')}"
LEAN = f"{FC}, {lean_sql('fc', 'q')}"


def risk_sql(source: str, name: str) -> str:
    tail = lambda s: f"list_sum({s}[{FIRST_LARGE + 1}:{K}])"
    depth = lambda s: f"list_sum(list_transform({ORDS}, lambda k: {s}[k + 1] * {MIDS}[k + 1]))"
    return f"""{name} AS (SELECT *, p_long - p_short AS edge, CASE WHEN p_long > p_short THEN p_short * {tail('down')} WHEN p_long < p_short THEN p_long * {tail('up')} ELSE greatest(p_short * {tail('down')}, p_long * {tail('up')}) END AS risk,
  (p_long * {depth('up')} - p_short * {depth('down')}) / 100 AS expected FROM {source} WHERE trained)"""


G = [f"CASE WHEN history >= {d.LEAST_HISTORY} THEN qs[{k + 1}] ELSE {g} END AS gate_{k}" for k, g in enumerate(d.STATIC_GATES)]


def graded_sql(source: str, name: str, order: str = "idx") -> str:
    """Gates and verdicts of a relation with edge, risk and expected."""
    return f"""{name}_1 AS (SELECT *, count(risk) OVER e AS history, quantile_cont(risk, {list(d.QUANTILES)}) OVER e AS qs FROM {source} WINDOW e AS (PARTITION BY symbol, horizon ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_2 AS (SELECT *, {', '.join(G)} FROM {name}_1),
{name} AS (SELECT *, CASE WHEN abs(edge) <= 0.05 OR NOT abs(expected) > {d.ROUND_TRIP_COST} THEN 'Hold' WHEN abs(edge) > 0.3 AND risk < gate_0 THEN CASE WHEN edge > 0 THEN 'Strong Buy' ELSE 'Strong Sell' END
  WHEN abs(edge) > 0.15 AND risk < gate_1 THEN CASE WHEN edge > 0 THEN 'Buy' ELSE 'Sell' END WHEN risk < gate_2 THEN CASE WHEN edge > 0 THEN 'Accumulate' ELSE 'Reduce' END ELSE 'Hold' END AS verdict FROM {name}_2)"""


DECIDED = f"{FC}, {risk_sql('fc', 'd0')}, {graded_sql('d0', 'dec')}"
SHARE = "CASE verdict " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.EXPOSURE.items()) + " END"
HELD = f"coalesce(last_value({SHARE} IGNORE NULLS) OVER (PARTITION BY symbol, horizon ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::double AS exposure"
EXPOSED = f"{DECIDED}, ex AS (SELECT *, {HELD} FROM dec)"
#: The exposure path at the prices at which it can be had: relation path.
EXECUTED = f"""{FC}, fe AS (SELECT fc.*, n.open AS next_open, n.close AS next_close FROM fc JOIN bi n ON n.symbol = fc.symbol AND n.idx = fc.idx + 1 WHERE n.open > 0 AND n.close > 0),
{risk_sql('fe', 'd0')}, {graded_sql('d0', 'dec')}, path AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY idx) - 1 AS pos, {HELD} FROM dec)"""
REPLAYED = f"""{EXECUTED}, rp AS (SELECT *, 1 + exposure * r - turn * 0.002 AS f FROM (SELECT *, later / next_close - 1 AS r, CASE WHEN later IS NOT NULL THEN abs(exposure - held) END AS turn
  FROM (SELECT *, lead(next_close) OVER w AS later, coalesce(lag(exposure) OVER w, 0) AS held FROM path WINDOW w AS (PARTITION BY symbol, horizon ORDER BY idx))))"""

# ---- labels and forecasts


@query(select(LAB, "lab", "symbol, open_time, horizon, forward, direction, depth_bin", "fwd_return"))
def forward_labels(spark, sf_dir):
    return labels(spark, sf_dir).select("symbol", "open_time", "horizon", "forward", "direction", "depth_bin", "fwd_return")


@query(select(LAB + ", x AS (SELECT symbol, horizon, count(direction) AS labelled, count_if(direction = 'long')::bigint AS longs, count_if(direction = 'short')::bigint AS shorts, count_if(direction = 'long') / count(direction) AS long_share FROM lab GROUP BY 1, 2)", "x", "symbol, horizon, labelled, longs, shorts", "long_share"))
def label_distribution(spark, sf_dir):
    return forecasts.label_distribution(labels(spark, sf_dir))


@query(f"WITH {LAB}, e AS (SELECT symbol, horizon, idx, target_time, lead(idx, 0) OVER () AS i FROM lab) SELECT symbol, horizon, count_if(target_time IS NOT NULL)::bigint AS scored_bars FROM e GROUP BY 1, 2")
def scored_bars(spark, sf_dir):
    return labels(spark, sf_dir).groupBy("symbol", "horizon").agg(F.count_if(c("target_time").isNotNull()).alias("scored_bars"))


@query(select(LAB, "(SELECT symbol, date_trunc('month', open_time) AS month, min(open_time) AS cutoff FROM bi GROUP BY 1, 2)", "symbol, month, cutoff"))
def refit_cutoffs(spark, sf_dir):
    return forecasts.cutoffs(daily_bars(spark, sf_dir))


@query(f"""WITH {LAB}, k AS (SELECT symbol, min(idx) AS at FROM bi GROUP BY symbol, date_trunc('month', open_time)), h AS (SELECT DISTINCT horizon, forward, forward + greatest(730, 3 * forward) AS w FROM lab)
SELECT k.symbol, h.horizon, k.at AS bar, count(*) AS n, count_if(direction = 'long')::bigint AS longs FROM k CROSS JOIN h JOIN lab ON lab.symbol = k.symbol AND lab.horizon = h.horizon AND lab.idx >= k.at - h.w AND lab.idx < k.at - h.forward AND direction IS NOT NULL GROUP BY ALL""")
def training_slice(spark, sf_dir):
    return forecasts.training_slice(labels(spark, sf_dir), 0).where("n > 0").withColumnRenamed("at", "bar")


@query(select(FC, "fc", "symbol, horizon, open_time, known, trained", "p_long, p_short"))
def baseline_forecast(spark, sf_dir):
    return baseline(spark, sf_dir).select("symbol", "horizon", "open_time", "known", "trained", "p_long", "p_short")


@query(f"WITH {FC} SELECT symbol, horizon, open_time, list_transform(up, lambda x: round(x + {market.SHIFT}, 6) + 0.0) AS up, list_transform(down, lambda x: round(x + {market.SHIFT}, 6) + 0.0) AS down FROM fc WHERE trained")
def empirical_depth(spark, sf_dir):
    return baseline(spark, sf_dir).where("trained").select("symbol", "horizon", "open_time", "up", "down")


IDEAL = "forward + greatest(730, 3 * forward)"
STEPS = f"CASE WHEN {IDEAL} <= n - 4 * forward THEN {IDEAL} ELSE greatest(forward + 30, least({IDEAL}, n // 2)) END::bigint"
HISTORY = f"n AS (SELECT symbol, count(*) AS n FROM bi GROUP BY symbol), h AS (SELECT DISTINCT horizon, forward FROM lab), ws AS (SELECT symbol, horizon, forward, n, {STEPS} AS steps FROM n CROSS JOIN h)"


def history(spark, sf_dir) -> DataFrame:
    """Bars of each symbol beside every horizon."""
    return daily_bars(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).crossJoin(d.horizons(spark))


@query(f"WITH {LAB}, {HISTORY} SELECT symbol, horizon, steps FROM ws")
def dynamic_window(spark, sf_dir):
    return history(spark, sf_dir).select("symbol", "horizon", d.window_steps(c("forward"), c("n")).cast("long").alias("steps"))


@query(f"""WITH {LAB}, {HISTORY}, r AS (SELECT symbol, horizon, forward, CASE horizon WHEN 'year' THEN 380 WHEN 'week' THEN 500 ELSE steps END::bigint AS steps FROM ws)
SELECT symbol, horizon, steps, steps AS window_days, steps - forward >= 30 AS usable, CASE WHEN steps - forward < 30 THEN forward + 31 END::bigint AS least_days FROM r""")
def resolve_windows(spark, sf_dir):
    """Windows with two horizons set by hand, one of them too short to train on."""
    return learning.resolve_windows(history(spark, sf_dir), overrides={"year": 380, "week": 500}).select("symbol", "horizon", "steps", "window_days", "usable", "least_days")


@query(select(f"{LAB}, {HISTORY}, sc AS (SELECT symbol, horizon, count(target_time) AS scored FROM lab GROUP BY 1, 2), s0 AS (SELECT * FROM ws JOIN sc USING (symbol, horizon))", "s0", "symbol, horizon, scored AS n, scored / forward < 3 OR (steps - forward) / forward < 3 AS low_power", "(steps - forward) / forward AS train_power, scored / forward AS scored_power"))
def window_power(spark, sf_dir):
    """Independent observations inside the window in use and among the scored bars."""
    scored = labels(spark, sf_dir).groupBy("symbol", "horizon").agg(F.count("target_time").alias("scored"))
    rows = history(spark, sf_dir).join(scored, ["symbol", "horizon"])
    train, power = d.effective_samples(d.window_steps(c("forward"), c("n")) - c("forward"), c("forward")), d.effective_samples(c("scored"), c("forward"))
    return rows.select("symbol", "horizon", c("scored").alias("n"), ((power < 3) | (train < 3)).alias("low_power"), train.alias("train_power"), power.alias("scored_power"))


POOLED = f"""{LAB}, p AS (SELECT a.horizon, a.symbol AS s1, b.symbol AS s2, corr(a.fwd_return, b.fwd_return) AS r, count(*) AS n FROM lab a JOIN lab b ON a.horizon = b.horizon AND a.open_time = b.open_time AND a.symbol < b.symbol WHERE a.fwd_return IS NOT NULL AND b.fwd_return IS NOT NULL GROUP BY 1, 2, 3),
sy AS (SELECT horizon, max(forward) AS forward, count(DISTINCT symbol) AS symbols, count(DISTINCT open_time) AS n, count(target_time) AS scored FROM lab GROUP BY 1), rr AS (SELECT horizon, avg(r) AS rho FROM p WHERE n >= 30 AND isfinite(r) GROUP BY 1),
ef AS (SELECT sy.*, symbols / (1 + (symbols - 1) * least(greatest(coalesce(rho, 0), 0), 1)) AS effective, CASE WHEN forward + greatest(730, 3 * forward) <= n - 4 * forward THEN forward + greatest(730, 3 * forward) ELSE greatest(forward + 30, least(forward + greatest(730, 3 * forward), n // 2)) END AS steps FROM sy LEFT JOIN rr USING (horizon)),
pw AS (SELECT horizon, effective, greatest(0, steps - forward) / forward * greatest(1, effective) AS train_power, scored / forward AS scored_power FROM ef),
pm AS (SELECT *, list_filter([CASE WHEN train_power < 3 THEN 'training window' END, CASE WHEN scored_power < 3 THEN 'scored range' END], lambda x: x IS NOT NULL) AS low FROM pw)"""


@query(select(POOLED, "pm", "horizon, low", "effective, train_power, scored_power"))
def pooled_power(spark, sf_dir):
    """Independent observations of a pool that trains and is scored together, and the sides of each horizon that have too few."""
    known = labels(spark, sf_dir)
    facts = known.groupBy("horizon").agg(F.max("forward").alias("forward"), F.count_distinct("open_time").alias("n"), F.count("target_time").alias("scored"))
    return forecasts.pooled_power(facts, correlation.return_correlation(known)).select("horizon", "low", "effective", "train_power", "scored_power")


@query(select(f"{LAB}, p AS (SELECT a.horizon, a.symbol AS s1, b.symbol AS s2, corr(a.fwd_return, b.fwd_return) AS r, count(*) AS n FROM lab a JOIN lab b ON a.horizon = b.horizon AND a.open_time = b.open_time AND a.symbol < b.symbol WHERE a.fwd_return IS NOT NULL AND b.fwd_return IS NOT NULL GROUP BY 1, 2, 3), sy AS (SELECT horizon, count(DISTINCT symbol) AS symbols FROM lab GROUP BY 1), m AS (SELECT horizon, symbols, count(*) AS pairs, avg(r) AS correlation, symbols / (1 + (symbols - 1) * least(greatest(avg(r), 0), 1)) AS effective FROM p JOIN sy USING (horizon) WHERE n >= 30 AND isfinite(r) GROUP BY 1, 2)", "m", "horizon, symbols, pairs", "correlation, effective"))
def return_correlation(spark, sf_dir):
    return correlation.return_correlation(labels(spark, sf_dir)).withColumn("effective", d.effective_symbols(c("symbols").cast("double"), c("correlation")))


@query(select(f"""{LAB}, ok AS (SELECT horizon, open_time, symbol, fwd_return AS r FROM lab WHERE fwd_return IS NOT NULL), al AS (SELECT horizon, open_time FROM ok GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ok)), o2 AS (SELECT * FROM ok SEMI JOIN al USING (horizon, open_time)),
pp AS (SELECT a.horizon, a.symbol AS s1, b.symbol AS s2, corr(a.r, b.r) AS r, count(*) AS n FROM o2 a JOIN o2 b ON a.horizon = b.horizon AND a.open_time = b.open_time AND a.symbol < b.symbol GROUP BY 1, 2, 3), cc AS (SELECT horizon, max(n) AS dates, avg(r) AS correlation FROM pp GROUP BY 1)""", "cc", "horizon, dates", "correlation"))
def common_date_correlation(spark, sf_dir):
    return correlation.common_correlation(labels(spark, sf_dir).where("fwd_return is not null"), "fwd_return", ["horizon"])


# ---- evaluation


@query(select(QUALITY, "q", "symbol, horizon, open_time, target_time, status, predicted, predicted_bin, correct, flags, reason", "confidence, entropy, brier, nll, depth_kl, depth_js, depth_abs_error_pct, quality_score, 100 - quality_score AS error_score"))
def score_forecasts(spark, sf_dir):
    names = "symbol, horizon, open_time, target_time, status, predicted, predicted_bin, correct, flags, reason, confidence, entropy, brier, nll, depth_kl, depth_js, depth_abs_error_pct, quality_score, error_score"
    return quality(spark, sf_dir).select(*names.split(", "))


CURVE = """cb AS (SELECT horizon, least(9, floor(confidence * 10))::int AS bin, count(*) AS n, avg(correct::int) AS accuracy, avg(confidence) AS mean_confidence FROM q WHERE status = 'scored' GROUP BY 1, 2),
curve AS (SELECT horizon, bin, coalesce(n, 0) AS n, coalesce(accuracy, 0) AS accuracy, coalesce(mean_confidence, 0) AS mean_confidence, abs(coalesce(accuracy, 0) - coalesce(mean_confidence, 0)) AS gap
  FROM (SELECT DISTINCT horizon FROM cb) CROSS JOIN (SELECT unnest(range(10))::int AS bin) LEFT JOIN cb USING (horizon, bin))"""


@query(select(f"{QUALITY}, {CURVE}", "curve", "horizon, bin, n", "accuracy, mean_confidence, gap"))
def calibration_curve(spark, sf_dir):
    return forecasts.calibration_curve(quality(spark, sf_dir), ["horizon"])


METRICS = f"""{CURVE}, ec AS (SELECT horizon, sum(n * gap) / sum(n) AS ece FROM curve GROUP BY 1),
m0 AS (SELECT horizon, count(*) AS samples, avg(correct::int) AS accuracy, avg(brier) AS brier, avg(nll) AS nll, avg(entropy) AS entropy, avg(confidence) AS confidence, avg(depth_kl) AS depth_kl, avg(depth_js) AS depth_js,
  avg(depth_abs_error_pct) AS depth_mae, sqrt(avg(depth_abs_error_pct * depth_abs_error_pct)) AS depth_rmse, avg(quality_score) AS score FROM q WHERE status = 'scored' GROUP BY 1), met AS (SELECT * FROM m0 JOIN ec USING (horizon))"""


@query(select(f"{QUALITY}, {METRICS}", "met", "horizon, samples", "accuracy, brier, nll, entropy, confidence, depth_kl, depth_js, depth_mae, depth_rmse, score, ece"))
def metrics_by_horizon(spark, sf_dir):
    return forecasts.metrics(quality(spark, sf_dir), ["horizon"])


OVER = ("accuracy", "brier", "nll", "entropy", "confidence", "depth_kl", "depth_js", "depth_mae", "ece")


@query(select(f"{QUALITY}, {METRICS}, o AS (SELECT sum(samples)::bigint AS samples, sum(samples * score) / sum(samples) AS model_score, {', '.join(f'sum(samples * {x}) / sum(samples) AS {x}' for x in OVER)}, (SELECT count_if(status = 'missing_target')::bigint FROM q) AS missing, (SELECT count_if(NOT trained)::bigint FROM fc) AS untrained FROM met)", "o", "samples, missing, untrained", "model_score, " + ", ".join(OVER)))
def metrics_overall(spark, sf_dir):
    """Means over all horizons, weighted by their samples, beside the forecasts without an outcome and those that were not trained."""
    made = baseline(spark, sf_dir)
    rows = forecasts.scored(made)
    weighted = lambda x: F.sum(c("samples") * c(x)) / F.sum("samples")
    total = forecasts.metrics(rows, ["horizon"]).agg(F.sum("samples").alias("samples"), weighted("score").alias("model_score"), *[weighted(x).alias(x) for x in OVER])
    missing = rows.agg(F.count_if(c("status") == "missing_target").alias("missing"))
    return total.crossJoin(missing).crossJoin(made.agg(F.count_if(~c("trained")).alias("untrained")))


@query(select(f"{QUALITY}, er AS (SELECT symbol, horizon, count(*) AS samples, avg(correct::int) AS accuracy, avg(quality_score) AS score, min(quality_score) AS worst, max(quality_score) AS best FROM q WHERE status = 'scored' GROUP BY 1, 2), em AS (SELECT symbol, horizon, count_if(status <> 'scored')::bigint AS unscored FROM q GROUP BY 1, 2), gp AS (SELECT symbol, count_if(d > interval 36 hour)::bigint AS gaps FROM (SELECT symbol, open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS d FROM bars) GROUP BY 1), ev AS (SELECT * FROM er JOIN em USING (symbol, horizon) JOIN gp USING (symbol))", "ev", "symbol, horizon, samples, unscored, gaps", "accuracy, score, worst, best"))
def evaluate_run(spark, sf_dir):
    """A run's evaluation in one table: scores by symbol and horizon, what could not be scored, and the gaps of the bars below it."""
    rows, bars = quality(spark, sf_dir), daily_bars(spark, sf_dir)
    ok = c("status") == "scored"
    out = rows.groupBy("symbol", "horizon").agg(F.count_if(ok).alias("samples"), F.count_if(~ok).alias("unscored"), F.avg(c("correct").cast("double")).alias("accuracy"), F.avg("quality_score").alias("score"), F.min("quality_score").alias("worst"), F.max("quality_score").alias("best"))
    found = quality_checks.gaps(bars, 86400 * 3 // 2).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"))
    return out.where("samples > 0").join(found, "symbol", "left").fillna({"gaps": 0})


STAB = f"""s1 AS (SELECT symbol, horizon, date_trunc('month', open_time) AS month, count(*) AS samples, avg(nll) AS logloss, avg(brier) AS brier, avg(correct::int) AS accuracy FROM q WHERE status = 'scored' GROUP BY 1, 2, 3),
st AS (SELECT symbol, month, horizon, coalesce(samples, 0) AS samples, logloss, brier, accuracy FROM (SELECT DISTINCT symbol, month FROM s1) CROSS JOIN (SELECT unnest({list(d.HORIZONS)}) AS horizon) LEFT JOIN s1 USING (symbol, month, horizon))"""


@query(select(f"{QUALITY}, {STAB}", "st", "symbol, horizon, month, samples, samples < 5 AS sparse", "logloss, brier, accuracy"))
def stability_by_month(spark, sf_dir):
    return forecasts.stability(quality(spark, sf_dir))


@query(select(f"{QUALITY}, {STAB}, ms AS (SELECT symbol, horizon, count(*) AS months, count_if(accuracy > 0.5) / count(*) AS share FROM st WHERE samples >= 20 GROUP BY 1, 2 HAVING count(*) >= 6)", "ms", "symbol, horizon, months", "share"))
def month_shares(spark, sf_dir):
    return shares(forecasts.stability(quality(spark, sf_dir)))


def shares(months: DataFrame, least: int = 20) -> DataFrame:
    return months.where(c("samples") >= least).groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("months"), (F.count_if(c("accuracy") > 0.5) / F.count(F.lit(1))).alias("share")).where("months >= 6")


@query(f"WITH {QUALITY} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM q) GROUP BY flag")
def flag_counts(spark, sf_dir):
    return quality(spark, sf_dir).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(select(QUALITY, "q WHERE list_contains(flags, 'high_entropy')", "symbol, horizon, open_time", "quality_score"))
def flagged_rows(spark, sf_dir):
    return quality(spark, sf_dir).where(F.array_contains("flags", "high_entropy")).select("symbol", "horizon", "open_time", "quality_score")


@query(select(QUALITY, "(SELECT * FROM q WHERE status = 'scored' ORDER BY quality_score, open_time, horizon, symbol LIMIT 100)", "symbol, horizon, open_time", "quality_score"))
def worst_predictions(spark, sf_dir):
    return quality(spark, sf_dir).where("status = 'scored'").orderBy("quality_score", "open_time", "horizon", "symbol").limit(100).select("symbol", "horizon", "open_time", "quality_score")


@query(select(f"{QUALITY}, wf AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY 100 - quality_score DESC, open_time, horizon, symbol) AS k FROM q WHERE status = 'scored' AND list_contains(flags, 'high_entropy'))", "wf WHERE k <= 250", "symbol, horizon, open_time, total", "quality_score, 100 - quality_score AS error_score"))
def worst_flagged(spark, sf_dir):
    """The 250 worst of the rows that carry a flag, with how many carry it."""
    return forecasts.worst(quality(spark, sf_dir), 250, "high_entropy").select("symbol", "horizon", "open_time", "total", "quality_score", "error_score")


SHARP = f"-list_sum(list_transform({{}}, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln({K})"


@query(select(f"{FC}, sh AS (SELECT symbol, horizon, avg(1 + (p_long * ln(p_long) + p_short * ln(p_short)) / ln(2)) AS sides, avg(1 - ({SHARP.format('up')})) AS up, avg(1 - ({SHARP.format('down')})) AS down FROM fc WHERE trained GROUP BY 1, 2)", "sh", "symbol, horizon", "sides, up, down"))
def sharpness(spark, sf_dir):
    """How far forecasts are from even ones, by the entropies of their sides and of their depth bins."""
    mean = lambda p, k: F.avg(d.sharpness(p, k))
    return baseline(spark, sf_dir).where("trained").groupBy("symbol", "horizon").agg(mean(F.array("p_long", "p_short"), 2).alias("sides"), mean(c("up"), K).alias("up"), mean(c("down"), K).alias("down"))


@query(select(f"{QUALITY}, b AS (SELECT symbol, horizon, avg(correct::int) AS accuracy, avg((predicted = 'long')::int) AS predicted_long, avg((direction = 'long')::int) AS actual_long, greatest(avg((direction = 'long')::int), 1 - avg((direction = 'long')::int)) AS majority FROM q WHERE status = 'scored' GROUP BY 1, 2)", "b", "symbol, horizon", "accuracy, predicted_long, actual_long, majority"))
def base_rate(spark, sf_dir):
    share = lambda x: F.avg(x.cast("double"))
    out = quality(spark, sf_dir).where("status = 'scored'").groupBy("symbol", "horizon").agg(share(c("correct")).alias("accuracy"), share(c("predicted") == "long").alias("predicted_long"), share(c("direction") == "long").alias("actual_long"))
    return out.withColumn("majority", F.greatest(c("actual_long"), 1 - c("actual_long")))


@query(select(f"{QUALITY}, y AS (SELECT symbol, horizon, year(open_time) AS year, count(*) AS bars, avg((predicted = 'long')::int) AS predicted_long, avg((direction = 'long')::int) AS actual_long, avg(correct::int) AS accuracy FROM q WHERE status = 'scored' GROUP BY 1, 2, 3)", "y", "symbol, horizon, year, bars", "predicted_long, actual_long, accuracy"))
def yearly_record(spark, sf_dir):
    share = lambda x: F.avg(x.cast("double"))
    return quality(spark, sf_dir).where("status = 'scored'").groupBy("symbol", "horizon", F.year("open_time").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("bars"), share(c("predicted") == "long").alias("predicted_long"), share(c("direction") == "long").alias("actual_long"), share(c("correct")).alias("accuracy"))


def side_lengths(rows: DataFrame) -> DataFrame:
    """symbol, horizon, runs, mean_length: stretches of bars for which the same side is predicted."""
    rows = numbered(settled(rows.select(*forecasts.HKEYS, "idx", "predicted")), forecasts.HKEYS)
    rows = beside(rows, {"change": lambda w: (~c("predicted").eqNullSafe(F.lag("predicted").over(w))).cast("long")}, forecasts.HKEYS, back=1)
    return rows.groupBy("symbol", "horizon").agg(F.sum("change").alias("runs"), (F.count(F.lit(1)) / F.sum("change")).alias("mean_length"))


@query(select(f"{QUALITY}, ch AS (SELECT *, (predicted IS DISTINCT FROM lag(predicted) OVER (PARTITION BY symbol, horizon ORDER BY idx))::int AS change FROM q), sr AS (SELECT symbol, horizon, sum(change)::bigint AS runs, count(*) / sum(change) AS mean_length FROM ch GROUP BY 1, 2)", "sr", "symbol, horizon, runs", "mean_length"))
def side_runs(spark, sf_dir):
    return side_lengths(quality(spark, sf_dir))



TWO = f"{COUNTED}, {several('tw', TWO_RUNS)}, {scored_sql('tw', 'q')}"
LEAN_TWO = f"{COUNTED}, {several('tw', TWO_RUNS)}, {lean_sql('tw', 'q')}"


@query(select(f"{TWO}, r AS (SELECT symbol, model, avg(quality_score) AS score, " + ", ".join(f"avg(correct::int) FILTER (WHERE horizon = '{h}') AS {h}" for h in d.HORIZONS) + " FROM q WHERE status = 'scored' GROUP BY 1, 2)", "r", "symbol, model", "score, " + ", ".join(d.HORIZONS)))
def run_ranking(spark, sf_dir):
    rows = forecasts.scored(two_models(spark, sf_dir)).where("status = 'scored'")
    by = rows.groupBy("symbol", "model").pivot("horizon", list(d.HORIZONS)).agg(F.avg(c("correct").cast("double")))
    return rows.groupBy("symbol", "model").agg(F.avg("quality_score").alias("score")).join(by, ["symbol", "model"]).orderBy(c("score").desc_nulls_last())


PAIRED = "pr AS (SELECT symbol, horizon, open_time, min(model) AS m1, max(model) AS m2, arg_min(correct::int, model) - arg_max(correct::int, model) AS hit, arg_min(nll, model) - arg_max(nll, model) AS loss FROM q WHERE status = 'scored' GROUP BY 1, 2, 3 HAVING count(*) = 2)"


@query(select(f"{LEAN_TWO}, {PAIRED}", "pr", "symbol, horizon, open_time, m1, m2, hit::bigint AS hit", "loss"))
def pair_forecasts(spark, sf_dir):
    return significance.paired(forecasts.scored(two_models(spark, sf_dir))).select("symbol", "horizon", "open_time", "m1", "m2", "hit", "loss")


@query(select(f"{LEAN_TWO}, s AS (SELECT horizon, model, avg(brier) AS brier, avg(nll) AS nll FROM (SELECT symbol, horizon, model, avg(brier) AS brier, avg(nll) AS nll FROM q WHERE status = 'scored' GROUP BY 1, 2, 3) GROUP BY 1, 2)", "s", "horizon, model", "brier, nll, brier - 0.5 AS brier_vs_coin, nll - ln(2) AS nll_vs_coin"))
def scoring_rules(spark, sf_dir):
    rows = forecasts.scored(two_models(spark, sf_dir)).where("status = 'scored'").groupBy("symbol", "horizon", "model").agg(F.avg("brier").alias("brier"), F.avg("nll").alias("nll"))
    out = rows.groupBy("horizon", "model").agg(F.avg("brier").alias("brier"), F.avg("nll").alias("nll"))
    return out.withColumns({"brier_vs_coin": c("brier") - 0.5, "nll_vs_coin": c("nll") - F.ln(F.lit(2.0))})


@query(f"WITH {FC} SELECT DISTINCT date_trunc('month', open_time) AS month, horizon FROM fc WHERE trained")
def forecast_months(spark, sf_dir):
    return baseline(spark, sf_dir).where("trained").select(F.date_trunc("month", "open_time").alias("month"), "horizon").distinct()


@query(select(f"{FC}, fm AS (SELECT *, count(*) OVER () AS matched, row_number() OVER (ORDER BY open_time, symbol, horizon) AS k FROM fc WHERE date_trunc('month', open_time) = timestamp '1999-05-01')", "fm WHERE k <= 250", "symbol, horizon, open_time, trained, matched, matched > 250 AS truncated", "p_long"))
def forecast_month(spark, sf_dir):
    return forecasts.one_month(baseline(spark, sf_dir), "1999-05", 250).select("symbol", "horizon", "open_time", "trained", "matched", "truncated", "p_long")


@query(f"WITH {FC}, u AS (SELECT symbol, horizon FROM fc WHERE trained UNION ALL SELECT symbol, 'decade' FROM fc WHERE horizon = 'year') SELECT symbol, horizon, count(*) AS n FROM u WHERE horizon IN {tuple(d.HORIZONS)} GROUP BY 1, 2")
def known_horizons(spark, sf_dir):
    """Forecasts of a run that also holds a horizon which this build does not know."""
    rows = baseline(spark, sf_dir)
    stored = rows.where("trained").select("symbol", "horizon").unionByName(rows.where("horizon = 'year'").select("symbol", F.lit("decade").alias("horizon")))
    return forecasts.known_horizons(stored).groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("n"))


@query(select(f"{QUALITY}, rc AS (SELECT *, p_long - p_short AS edge, count(*) OVER () > 500 AS truncated, row_number() OVER (ORDER BY quality_score DESC, round(abs(p_long - p_short), 9) DESC, open_time, horizon, symbol) AS k FROM q WHERE status = 'scored')", "rc WHERE k <= 500", "symbol, horizon, open_time, predicted, direction, truncated", "quality_score, edge, confidence"))
def top_recommendations(spark, sf_dir):
    return forecasts.recommendations(quality(spark, sf_dir)).select("symbol", "horizon", "open_time", "predicted", "direction", "truncated", "quality_score", "edge", "confidence")


@query(f"WITH {FC} SELECT symbol, horizon, count_if(trained)::bigint AS trained, count_if(NOT trained)::bigint AS untrained FROM fc GROUP BY 1, 2")
def exclude_untrained(spark, sf_dir):
    return baseline(spark, sf_dir).groupBy("symbol", "horizon").agg(F.count_if("trained").alias("trained"), F.count_if(~c("trained")).alias("untrained"))


# ---- decisions and economics


@query(select(DECIDED, "dec", "symbol, horizon, open_time, history, verdict", "edge, risk, expected, gate_0, gate_1, gate_2"))
def graded_sequence(spark, sf_dir):
    return forecasts.decisions(baseline(spark, sf_dir)).select("symbol", "horizon", "open_time", "history", "verdict", "edge", "risk", "expected", "gate_0", "gate_1", "gate_2")


@query(f"WITH {DECIDED} SELECT horizon, verdict, count(*) AS n FROM dec GROUP BY 1, 2")
def verdict_counts(spark, sf_dir):
    return forecasts.decisions(baseline(spark, sf_dir)).groupBy("horizon", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(select(f"{FC}, {risk_sql('fc', 'd0')}, wk AS (SELECT symbol, horizon, date_trunc('week', open_time)::timestamp AS monday, avg(edge) AS edge, avg(risk) AS risk, avg(expected) AS expected, count(*) AS bars FROM d0 GROUP BY 1, 2, 3)", "wk", "symbol, horizon, monday, bars", "edge, risk, expected"))
def weekly_windows(spark, sf_dir):
    return forecasts.weekly_windows(baseline(spark, sf_dir)).select("symbol", "horizon", "monday", "bars", "edge", "risk", "expected")


@query(select(f"{FC}, {risk_sql('fc', 'd0')}, wk AS (SELECT symbol, horizon, date_trunc('week', open_time)::timestamp AS monday, avg(edge) AS edge, avg(risk) AS risk, avg(expected) AS expected, count(*) AS bars FROM d0 GROUP BY 1, 2, 3), {graded_sql('wk', 'pg', 'monday')}, pw AS (SELECT *, strftime(monday, '%Y-%m') AS month, abs(expected) > {d.ROUND_TRIP_COST} AS cost_cleared FROM pg)", "pw", "symbol, horizon, monday, month, bars, history, verdict, cost_cleared", "edge, risk, expected, gate_0, gate_1, gate_2"))
def plan_windows(spark, sf_dir):
    return forecasts.plan_windows(baseline(spark, sf_dir)).select("symbol", "horizon", "monday", "month", "bars", "history", "verdict", "cost_cleared", "edge", "risk", "expected", "gate_0", "gate_1", "gate_2")


@query(select(EXPOSED, "ex", "symbol, horizon, open_time, verdict", "exposure"))
def carried_exposure(spark, sf_dir):
    decided = settled(forecasts.decisions(baseline(spark, sf_dir)).select(*forecasts.HKEYS, "idx", "open_time", "verdict"))
    return forecasts.exposure(decided).select("symbol", "horizon", "open_time", "verdict", "exposure")


def path(spark, sf_dir) -> DataFrame:
    bars = daily_bars(spark, sf_dir)
    return economics.executed(forecasts.baseline(forecasts.labels(bars)), bars)


@query(select(EXECUTED, "path", "symbol, horizon, open_time, verdict", "next_open, next_close, exposure"))
def exposure_path(spark, sf_dir):
    return path(spark, sf_dir).select("symbol", "horizon", "open_time", "verdict", "next_open", "next_close", "exposure")


@query(f"WITH {EXECUTED.replace("'Buy' THEN 0.7", "'Buy' THEN 0.5")} SELECT symbol, horizon, round(exposure, 6) AS exposure, count(*) AS bars FROM path GROUP BY ALL")
def exposure_policy(spark, sf_dir):
    """Bars at each exposure when the share of one grade is set by hand."""
    bars = daily_bars(spark, sf_dir)
    rows = economics.executed(forecasts.baseline(forecasts.labels(bars)), bars, d.exposure_policy("buy=0.5"))
    return rows.groupBy("symbol", "horizon", F.round("exposure", 6).alias("exposure")).agg(F.count(F.lit(1)).alias("bars"))


def replayed(spark, sf_dir):
    return settled(forecasts.replay(path(spark, sf_dir)))


ROI = "CASE WHEN min(f) <= 0 THEN -1.0 ELSE least(1e9, exp(coalesce(sum(ln(greatest(f, 1e-300))) FILTER (WHERE f IS NOT NULL), 0)) - 1) END AS roi, avg(exposure) AS mean_exposure, coalesce(sum(turn), 0) AS turnover, count_if(turn > 0)::bigint AS trades, count(*) AS bars"


@query(select(f"{REPLAYED}, ro AS (SELECT symbol, horizon, {ROI} FROM rp GROUP BY 1, 2)", "ro", "symbol, horizon, trades, bars", "roi, mean_exposure, turnover"))
def replay_roi(spark, sf_dir):
    return forecasts.roi(replayed(spark, sf_dir)).drop("interval").withColumn("roi", F.least(c("roi"), F.lit(1e9)))


@query(select(EXECUTED, "path", "symbol, horizon, open_time, verdict", "next_open, next_close"))
def next_bar_execution(spark, sf_dir):
    return path(spark, sf_dir).select("symbol", "horizon", "open_time", "verdict", "next_open", "next_close")


@query(select(f"{EXECUTED}, hb AS (SELECT symbol, horizon, arg_min(next_open, idx) AS entry, arg_max(next_close, idx) AS exit FROM path GROUP BY 1, 2), ho AS (SELECT *, exit / entry * (1 - 0.002) - 1 AS roi FROM hb)", "ho", "symbol, horizon", "entry, exit, roi"))
def buy_and_hold(spark, sf_dir):
    return economics.buy_and_hold(path(spark, sf_dir), 0.002).drop("interval")


@query(select(f"""{BARS}, mo AS (SELECT symbol, open_time, close, CASE WHEN close > lag(close, 7) OVER w THEN 1.0 ELSE 0.0 END AS exposure FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
mr AS (SELECT *, lead(close) OVER w / close - 1 AS r, CASE WHEN lead(close) OVER w IS NOT NULL THEN abs(exposure - coalesce(lag(exposure) OVER w, 0)) END AS turn FROM mo WINDOW w AS (PARTITION BY symbol ORDER BY open_time)), mf AS (SELECT *, 1 + exposure * r - turn * 0.002 AS f FROM mr),
mm AS (SELECT symbol, {ROI} FROM mf GROUP BY 1)""", "mm", "symbol, trades, bars", "roi, mean_exposure, turnover"))
def naive_momentum(spark, sf_dir):
    return economics.momentum(daily_bars(spark, sf_dir), 7).drop("interval").withColumn("roi", F.least(c("roi"), F.lit(1e9)))


FALLS = f"""eq AS (SELECT symbol, horizon, idx, f, sum(ln(greatest(f, 1e-300))) OVER w AS le FROM rp WHERE f IS NOT NULL WINDOW w AS (PARTITION BY symbol, horizon ORDER BY idx)),
dd AS (SELECT *, exp(le - max(le) OVER w) - 1 AS fall FROM eq WINDOW w AS (PARTITION BY symbol, horizon ORDER BY idx)),
ps AS (SELECT symbol, horizon, -min(fall) AS max_drawdown, avg(f - 1) / nullif(stddev_samp(f - 1), 0) * sqrt(365) AS sharpe FROM dd GROUP BY 1, 2)"""


@query(select(f"{REPLAYED}, {FALLS}", "ps", "symbol, horizon", "max_drawdown, sharpe"))
def path_stats(spark, sf_dir):
    return economics.path_stats(replayed(spark, sf_dir)).drop("interval")


CONSTANT = "ce AS (SELECT symbol, horizon, avg(exposure) AS exposure, arg_min(next_close, idx) AS first, arg_max(next_close, idx) AS last FROM path GROUP BY 1, 2), co AS (SELECT symbol, horizon, exposure, exposure * ((1 - 0.002) * last / first - 1) AS roi FROM ce)"


@query(select(f"{EXECUTED}, {CONSTANT}", "co", "symbol, horizon", "exposure, roi"))
def constant_exposure(spark, sf_dir):
    return economics.constant_exposure(path(spark, sf_dir), 0.002).drop("interval")


#: Every circular shift of every path, for DuckDB: relation mt.
SHIFTS = """sn AS (SELECT symbol, horizon, count(*) AS n, arg_max(exposure, pos) AS fin FROM path GROUP BY 1, 2 HAVING count(*) >= 3),
st AS (SELECT symbol, horizon, pos, exposure, abs(exposure - coalesce(lag(exposure) OVER (PARTITION BY symbol, horizon ORDER BY pos), fin)) AS turned, lead(next_close) OVER (PARTITION BY symbol, horizon ORDER BY pos) / next_close - 1 AS r, n FROM path JOIN sn USING (symbol, horizon)),
sp AS (SELECT a.symbol, a.horizon, (b.pos - a.pos + a.n) % a.n AS shift, 1 + b.exposure * a.r - (CASE WHEN a.pos = 0 THEN abs(b.exposure) ELSE b.turned END) * 0.002 AS f FROM st a JOIN st b ON a.symbol = b.symbol AND a.horizon = b.horizon WHERE a.r IS NOT NULL),
sg AS (SELECT symbol, horizon, shift, CASE WHEN min(f) <= 0 THEN -1e300 ELSE sum(ln(greatest(f, 1e-300))) END AS growth FROM sp GROUP BY 1, 2, 3),
sr AS (SELECT symbol, horizon, growth AS real FROM sg WHERE shift = 0),
mt AS (SELECT symbol, horizon, count(*) AS samples, 100 * sum(CASE WHEN abs(growth - real) <= 1e-9 THEN 0.5 WHEN growth < real THEN 1.0 ELSE 0.0 END) / count(*) AS percentile, least(1e9, quantile_cont(exp(growth) - 1, 0.5)) AS median_roi FROM sg JOIN sr USING (symbol, horizon) WHERE shift > 0 GROUP BY 1, 2)"""


@query(select(f"{EXECUTED}, {SHIFTS}", "mt", "symbol, horizon, samples", "percentile, median_roi"))
def mistimed_replay(spark, sf_dir):
    return economics.mistimed(path(spark, sf_dir)).select("symbol", "horizon", "samples", "percentile", F.least(c("median_roi"), F.lit(1e9)).alias("median_roi"))


def summary_sql(model: str) -> str:
    """Of one model's forecasts (relation tw): a row a path, as `economics.summary`."""
    rest = REPLAYED[len(FC) + 2 :]
    return f"""SELECT '{model}' AS model, s.* FROM (WITH fc AS (SELECT * FROM tw WHERE model = '{model}'), {rest}, {SHIFTS}, {FALLS}, {CONSTANT},
ro AS (SELECT symbol, horizon, {ROI} FROM rp GROUP BY 1, 2), hb AS (SELECT symbol, horizon, arg_min(next_open, idx) AS entry, arg_max(next_close, idx) AS exit FROM path GROUP BY 1, 2),
mo AS (SELECT symbol, open_time, close, CASE WHEN close > lag(close, 7) OVER w THEN 1.0 ELSE 0.0 END AS exposure FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
mr AS (SELECT *, lead(close) OVER w / close - 1 AS r, CASE WHEN lead(close) OVER w IS NOT NULL THEN abs(exposure - coalesce(lag(exposure) OVER w, 0)) END AS turn FROM mo WINDOW w AS (PARTITION BY symbol ORDER BY open_time)), mf AS (SELECT *, 1 + exposure * r - turn * 0.002 AS f FROM mr),
mm AS (SELECT symbol, {ROI} FROM mf GROUP BY 1)
SELECT symbol, count(*) AS paths, avg(least(ro.roi, 1e9)) AS roi, avg(least(ro.roi, 1e9) - (exit / entry * (1 - 0.002) - 1)) AS over_hold, avg(least(ro.roi, 1e9) - co.roi) AS over_constant, avg(least(ro.roi, 1e9) - least(mm.roi, 1e9)) AS over_momentum, avg(percentile) AS percentile, avg(max_drawdown) AS max_drawdown
FROM ro JOIN hb USING (symbol, horizon) JOIN co USING (symbol, horizon) JOIN mm USING (symbol) LEFT JOIN mt USING (symbol, horizon) LEFT JOIN ps USING (symbol, horizon) GROUP BY symbol) s"""


@query(select(f"{COUNTED}, {several('tw', TWO_RUNS)}, bt AS ({' UNION ALL '.join(summary_sql(m) for m, _, _ in TWO_RUNS)})", "bt", "symbol, model, paths", "roi, over_hold, over_constant, over_momentum, percentile, max_drawdown"))
def backtest_summary(spark, sf_dir):
    """Means over the horizons of what each symbol's and model's paths gain over simpler strategies."""
    bars = daily_bars(spark, sf_dir)
    rows = settled(forecasts.several(forecasts.labels(bars), TWO_RUNS))
    each = [economics.summary(economics.executed(rows.where(c("model") == m).drop("model", "seed"), bars), bars, most=1e9).withColumn("model", F.lit(m)) for m, _, _ in TWO_RUNS]
    every = reduce(DataFrame.unionByName, each)
    return every.groupBy("symbol", "model").agg(F.count(F.lit(1)).alias("paths"), *[F.avg(x).alias(x) for x in ("roi", "over_hold", "over_constant", "over_momentum", "percentile", "max_drawdown")])


# ---- significance


HITS = "hit AS (SELECT symbol, horizon, forward, row_number() OVER (PARTITION BY symbol, horizon ORDER BY idx) - 1 AS pos, correct::int AS x FROM q WHERE status = 'scored')"
BOOT = f"{LEAN}, {HITS}, {significance.boot_sql('hit', 'boot', 'symbol, horizon', 'x', 'avg(x)', 'S(x) / max(n)')}"


ERROR_EDGES = [0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0, 55.0, 89.0, 144.0]


def _median_sql(total: str, n: str) -> str:
    """SQL of `significance.median_of`'s finish; total has {} for a bin's name."""
    sums = [total.format(f"bin_{k}") for k in range(len(ERROR_EDGES))]
    parts = []
    for k, (a, b) in enumerate(zip(ERROR_EDGES, [*ERROR_EDGES[1:], ERROR_EDGES[-1]], strict=True)):
        before = " + ".join(sums[:k]) or "0.0"
        parts.append(f"WHEN {before} + {sums[k]} >= {n} / 2 THEN {a} + ({n} / 2 - ({before})) / {sums[k]} * {b - a}")
    return f"CASE {' '.join(parts)} END"


_BINS = ", ".join(f"(depth_abs_error_pct >= {a}{f' AND depth_abs_error_pct < {b}' if b else ''})::int::double AS bin_{k}" for k, (a, b) in enumerate(zip(ERROR_EDGES, [*ERROR_EDGES[1:], None], strict=True)))
MEDIANS = f"""{QUALITY}, me AS (SELECT symbol, horizon, forward, row_number() OVER (PARTITION BY symbol, horizon ORDER BY idx) - 1 AS pos, {_BINS} FROM q WHERE status = 'scored'),
{significance.boot_sql('me', 'mb', 'symbol, horizon', ', '.join(f'bin_{k}' for k in range(len(ERROR_EDGES))), _median_sql('sum({})', 'count(*)'), _median_sql('S({})', 'max(n)'), 5.0, 300)}"""


@query(select(MEDIANS, "mb", "symbol, horizon, n, resamples", "value, low, high, p_value"))
def median_error_ci(spark, sf_dir):
    """The median depth error, a statistic that is no mean, with its interval against 5 percent."""
    rows = quality(spark, sf_dir).where("status = 'scored'")
    return significance.statistic_interval(rows, ["symbol", "horizon"], *significance.median_of(c("depth_abs_error_pct"), ERROR_EDGES), resamples=300, reference=5.0)


def accuracy(spark, sf_dir) -> DataFrame:
    return significance.mean_interval(significance.hits(quality(spark, sf_dir)))


@query(select(BOOT, "boot", "symbol, horizon, n, resamples", "value, low, high, p_value"))
def accuracy_ci(spark, sf_dir):
    return accuracy(spark, sf_dir)


@query(select(f"{BOOT}, {significance.bh_sql('boot', 'bh', 'symbol, horizon')}", "bh", "symbol, horizon", "p_value, q_value"))
def benjamini_hochberg(spark, sf_dir):
    return significance.benjamini_hochberg(accuracy(spark, sf_dir)).select("symbol", "horizon", "p_value", "q_value")


@query(select(BOOT, "boot", "symbol, horizon, CASE WHEN low IS NULL THEN NULL WHEN low > 0.5 THEN 'above' WHEN high < 0.5 THEN 'below' ELSE 'indistinguishable' END AS verdict"))
def versus(spark, sf_dir):
    return accuracy(spark, sf_dir).select("symbol", "horizon", significance.versus(c("low"), c("high"), 0.5).alias("verdict"))


@query(select(f"{LEAN}, {HITS.replace('correct::int AS x', 'brier AS x')}, {significance.boot_sql('hit', 'boot', 'symbol, horizon', 'x', 'avg(x)', 'S(x) / max(n)')}", "boot", "symbol, horizon, n, resamples", "value, low, high, p_value"))
def mean_ci(spark, sf_dir):
    """The mean Brier score with its interval, against a coin's."""
    rows = significance.hits(quality(spark, sf_dir), also=("brier",)).drop("x").withColumnRenamed("brier", "x")
    return significance.mean_interval(rows, reference=0.5)


BINS = range(10)
GAPS = "eg AS (SELECT symbol, horizon, forward, row_number() OVER (PARTITION BY symbol, horizon ORDER BY idx) - 1 AS pos, " + ", ".join(f"CASE WHEN least(9, floor(confidence * 10)) = {k} THEN correct::int - confidence ELSE 0 END AS g{k}" for k in BINS) + " FROM q WHERE status = 'scored')"
ECE = significance.boot_sql("eg", "eb", "symbol, horizon", ", ".join(f"g{k}" for k in BINS), "(" + " + ".join(f"abs(sum(g{k}))" for k in BINS) + ") / count(*)", "(" + " + ".join(f"abs(S(g{k}))" for k in BINS) + ") / max(n)")


@query(select(f"{LEAN}, {GAPS}, {ECE}", "eb", "symbol, horizon, n, resamples", "value, low, high"))
def ece_ci(spark, sf_dir):
    return significance.calibration_error_interval(quality(spark, sf_dir))


# ---- temperatures

GRID = ", ".join(f"({k}, {t}::double)" for k, t in enumerate(d.TEMPERATURES))


def temperature_sql(keys: str) -> str:
    """Fits of relation q by keys: relations tn (mean loss at each temperature) and tt."""
    raised = lambda p: f"pow(greatest({p}, 1e-12), 1 / t)"
    able = f"max(n) >= {d.LEAST_FITTED} AND max(kinds) > 1"
    return f"""g AS (SELECT * FROM (VALUES {GRID}) v(ord, t)), tn AS (SELECT {keys}, ord, t, count(*) AS n, count(DISTINCT direction) AS kinds, avg(-ln(greatest({raised('p_true')} / ({raised('p_true')} + {raised('(1 - p_true)')}), 1e-12))) AS nll FROM q CROSS JOIN g WHERE status = 'scored' GROUP BY {keys}, ord, t),
tt AS (SELECT {keys}, CASE WHEN {able} THEN arg_min(t, (round(nll, 9), ord)) ELSE 1.0 END::double AS temperature, CASE WHEN {able} THEN max(n) ELSE 0 END::bigint AS fitted_on, CASE WHEN {able} THEN arg_min(nll, (round(nll, 9), ord)) ELSE max(CASE WHEN t = 1.0 THEN nll END) END AS nll FROM tn GROUP BY {keys})"""


def outcomes(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.where("status = 'scored'").select(*keys, "p_long", (c("direction") == "long").alias("is_long"))


@query(select(f"{LEAN}, {temperature_sql('horizon')}", "tt", "horizon, fitted_on", "temperature, nll"))
def fit_temperature(spark, sf_dir):
    return calibration.fit_temperature(outcomes(quality(spark, sf_dir), "horizon"), ["horizon"])


@query(select(f"{LEAN}, {temperature_sql('symbol, horizon')}, cl AS (SELECT symbol, horizon, max(n) AS n, CASE WHEN max(kinds) > 1 THEN min(nll) ELSE max(CASE WHEN t = 1.0 THEN nll END) END AS nll FROM tn GROUP BY 1, 2)", "cl", "symbol, horizon, n", "nll"))
def calibrated_nll(spark, sf_dir):
    return calibration.calibrated_nll(outcomes(quality(spark, sf_dir), "symbol", "horizon"), ["symbol", "horizon"])


QUARTERS = f"{FC}, q AS (SELECT * FROM (SELECT *, date_trunc('quarter', open_time)::timestamp AS quarter, CASE WHEN direction IS NOT NULL THEN 'scored' END AS status, CASE WHEN direction = 'long' THEN p_long ELSE p_short END AS p_true FROM fc WHERE trained))"
#: A quarter's temperature comes from the forecasts of the quarter a year and more before, whose outcomes are known at every horizon.
MEMORY = f"""{QUARTERS}, {temperature_sql('symbol, horizon, quarter')}, wq AS (SELECT DISTINCT symbol, horizon, quarter FROM q), fq AS (SELECT w.symbol, w.horizon, w.quarter, coalesce(t.temperature, 1.0) AS temperature, coalesce(t.fitted_on, 0) AS fitted_on FROM wq w LEFT JOIN tt t ON t.symbol = w.symbol AND t.horizon = w.horizon AND t.quarter + interval 15 month = w.quarter),
mem AS (SELECT symbol, horizon, quarter, fitted_on, CASE WHEN fitted_on > 0 THEN 'fitted' WHEN was IS NOT NULL THEN 'carried' ELSE 'prior' END AS source, coalesce(CASE WHEN fitted_on > 0 THEN temperature END, was, {d.TEMPERATURES[-1]}) AS temperature
  FROM (SELECT *, last_value(CASE WHEN fitted_on > 0 THEN temperature END IGNORE NULLS) OVER (PARTITION BY symbol, horizon ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM fq))"""


def quarters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(trained forecasts with their quarter, the temperature in use in each quarter)."""
    keys = ["symbol", "horizon", "quarter"]
    rows = baseline(spark, sf_dir).where("trained").withColumn("quarter", F.date_trunc("quarter", "open_time"))
    known = rows.where("direction is not null").select(*keys, "p_long", (c("direction") == "long").alias("is_long"))
    fits = calibration.fit_temperature(known, keys).withColumn("quarter", c("quarter") + F.expr("interval 15 months"))
    windows = rows.select(*keys).distinct().join(fits, keys, "left").fillna({"temperature": 1.0, "fitted_on": 0})
    return rows, calibration.temperature_memory(windows, ["symbol", "horizon"], "quarter")


@query(select(MEMORY, "mem", "symbol, horizon, quarter, source, fitted_on", "temperature"))
def temperature_memory(spark, sf_dir):
    return quarters(spark, sf_dir)[1].select("symbol", "horizon", "quarter", "source", "fitted_on", "temperature")


HOT = "pow(greatest(p_long, 1e-12), 1 / temperature)"
CALIBRATED = f"""{MEMORY}, ca AS (SELECT q.symbol, q.horizon, q.open_time, m.source, m.fitted_on, m.temperature, q.p_long AS raw_long, q.p_short AS raw_short, CASE WHEN abs(temperature - 1) < 1e-9 THEN p_long ELSE {HOT} / ({HOT} + {HOT.replace('p_long', 'p_short')}) END AS cal_long
  FROM q JOIN mem m ON m.symbol = q.symbol AND m.horizon = q.horizon AND m.quarter = q.quarter)"""


@query(select(CALIBRATED, "ca", "symbol, horizon, open_time, source, fitted_on AS calibrated_on", "temperature, raw_long, cal_long AS p_long"))
def calibrate_forecasts(spark, sf_dir):
    rows, memory = quarters(spark, sf_dir)
    out = calibration.calibrate(rows, memory, ["symbol", "horizon", "quarter"])
    return out.select("symbol", "horizon", "open_time", "source", c("calibration.calibrated_on").alias("calibrated_on"), "temperature", "raw_long", "p_long")


@query(select(f"{CALIBRATED}, tf AS (SELECT horizon, count(*) AS forecasts, quantile_cont(CASE WHEN source = 'fitted' THEN temperature END, 0.5) AS median_temperature, avg(CASE WHEN source = 'fitted' THEN (temperature > 10)::int END) AS above_ten, avg(abs(raw_long - raw_short)) AS edge_raw, avg(abs(2 * cal_long - 1)) AS edge_calibrated, avg((source <> 'fitted')::int) AS without_slice FROM ca GROUP BY 1)", "tf", "horizon, forecasts", "median_temperature, above_ten, edge_raw, edge_calibrated, without_slice"))
def temperature_facts(spark, sf_dir):
    rows, memory = quarters(spark, sf_dir)
    return calibration.temperature_facts(calibration.calibrate(rows, memory, ["symbol", "horizon", "quarter"]), ["horizon"])


# Names of round 1, whose rule the queries above now have.
for _name in ("accuracy_ci", "benjamini_hochberg", "versus", "month_shares"):
    FOUND[f"{_name}_whole"] = FOUND[_name]


def queries() -> dict:
    return {k: v[0] for k, v in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in FOUND.items() if v[1]}
