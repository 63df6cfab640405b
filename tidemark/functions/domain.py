"""Fixed vocabularies and scalar rules as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Horizons in days, depth bins in percent, interval lengths in minutes, exposure by grade.
HORIZONS = {"week": 7, "month": 28, "quarter": 91, "year": 364}
DEPTH_EDGES = [0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]
DEPTH_BINS = [f"{a}-{b}" for a, b in zip(DEPTH_EDGES, DEPTH_EDGES[1:], strict=False)] + ["144+"]
MIDPOINTS = [(a + b) / 2 for a, b in zip(DEPTH_EDGES, DEPTH_EDGES[1:], strict=False)] + [144 * 1.25]
LARGE_MOVE = 13.0
INTERVALS = {"1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "8h": 480, "12h": 720, "1d": 1440, "3d": 4320, "1w": 10080}
EXPOSURE = {"Strong Buy": 1.0, "Buy": 0.7, "Accumulate": 0.4, "Reduce": 0.2, "Sell": 0.0, "Strong Sell": 0.0}
STATIC_GATES, QUANTILES, LEAST_HISTORY = (0.20, 0.30, 0.40), (0.40, 0.70, 0.90), 52
ROUND_TRIP_COST, MIN_TRAIN, MIN_ROWS, MIN_INDEPENDENT = 0.004, 30, 730, 3
# Temperatures tried, in order.
TEMPERATURES = (
    0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 5.0, 7.0, 10.0,
    15.0, 20.0, 30.0, 50.0, 70.0, 100.0, 150.0, 200.0, 300.0, 500.0, 1000.0,
)
LEAST_FITTED, HELD_OUT = 40, 0.25
# The columns that models are trained on, in order.
TRAINING_COLUMNS = (
    "log_return_1b", "log_return_3b", "log_return_7b", "log_return_14b", "rolling_vol_7", "rolling_vol_14", "rolling_vol_30",
    "realized_vol_1d", "candle_range", "rolling_drawdown_30", "rolling_drawdown_90", "max_intraday_drawdown", "jump_count", "rsi_14",
    "taker_buy_ratio", "taker_buy_ratio_14", "flow_imbalance", "trade_count_rel_30",
    "ma_10_rel", "ma_30_rel", "ma_diff_rel", "ma_slope_rel", "bb_mid_rel", "bb_upper_rel", "bb_lower_rel", "atr_14_rel", "macd_hist_rel",
    "open_rel", "high_rel", "low_rel", "volume_rel_30", "obv_change_rel", "avg_trade_size_rel_30",
)


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles by IEEE 754, also where b is 0: an infinity, or no number for 0 / 0."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def interval_steps(days: Column, interval: Column) -> Column:
    """Bars of an interval in a number of days, half to even, one at least; null for an unknown interval."""
    minutes = F.create_map(*[F.lit(x) for k, v in INTERVALS.items() for x in (k, v)])
    return F.greatest(F.lit(1), F.bround(days * 1440 / F.try_element_at(minutes, interval), 0).cast("long"))


def effective_samples(n: Column, forward: Column) -> Column:
    return F.when(forward <= 0, n.cast("double")).otherwise(F.try_divide(n.cast("double"), forward))


def effective_symbols(count: Column, rho: Column) -> Column:
    return count / (1 + (count - 1) * F.least(F.greatest(rho, F.lit(0.0)), F.lit(1.0)))


def direction(r: Column) -> Column:
    return F.when(r > 0, "long").when(r < 0, "short")


def depth_index(pct: Column) -> Column:
    """Number of the first bin with low <= pct < high; null below the first edge."""
    return reduce(lambda out, k: F.when(pct >= DEPTH_EDGES[k], k).otherwise(out), range(len(DEPTH_EDGES)), F.lit(None).cast("int"))


def depth_label(k: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, DEPTH_BINS)), k + 1)


def normalized(values: Column, n: int) -> Column:
    """An array of probabilities: negatives and non-finite values are 0, the sum is 1, uniform where nothing is left."""
    clean = F.transform(values, lambda p: F.when((p > 0) & (p < float("inf")) & ~F.isnan(p), p).otherwise(F.lit(0.0)))
    total = F.aggregate(clean, F.lit(0.0), lambda a, p: a + p)
    return F.when(total > 1e-12, F.transform(clean, lambda p: p / total)).otherwise(F.array_repeat(F.lit(1.0 / n), n))


def brier(p_long: Column, p_short: Column, is_long: Column) -> Column:
    y = is_long.cast("double")
    return (p_long - y) * (p_long - y) + (p_short - (1 - y)) * (p_short - (1 - y))


def nll(p_true: Column) -> Column:
    return -F.ln(F.greatest(p_true, F.lit(1e-12)))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0)))


def max_entropy(kinds: int) -> Column:
    """Entropy of an even distribution over a number of kinds, two at least."""
    return F.ln(F.lit(float(max(2, kinds))))


def sharpness(p: Column, kinds: int) -> Column:
    """1 for a certain forecast, 0 for an even one."""
    return 1 - entropy(p) / max_entropy(kinds)


def kl(p: Column, q: Column) -> Column:
    floor = lambda x: F.greatest(x, F.lit(1e-12))
    return F.aggregate(F.zip_with(p, q, lambda x, y: floor(x) * F.ln(floor(x) / floor(y))), F.lit(0.0), lambda a, x: a + x)


def js(p: Column, q: Column) -> Column:
    mid = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kl(p, mid) + kl(q, mid)) / 2


def expected_depth(p: Column) -> Column:
    return F.aggregate(F.zip_with(p, F.array(*map(F.lit, MIDPOINTS)), lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)


def argmax(p: Column) -> Column:
    """Index from 0 of the largest value; the lowest of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def tail(p: Column) -> Column:
    first = next(k for k, e in enumerate(DEPTH_EDGES) if e >= LARGE_MOVE)
    return F.aggregate(F.slice(p, first + 1, len(DEPTH_BINS) - first), F.lit(0.0), lambda a, x: a + x)


def edge(p_long: Column, p_short: Column) -> Column:
    return p_long - p_short


def risk(p_long: Column, p_short: Column, up: Column, down: Column) -> Column:
    """Probability of the adverse side times its mass in large moves; on a tie the worse tail."""
    adverse, other = p_short * tail(down), p_long * tail(up)
    return F.when(p_long > p_short, adverse).when(p_long < p_short, other).otherwise(F.greatest(adverse, other))


def expected_move(p_long: Column, p_short: Column, up: Column, down: Column) -> Column:
    return (p_long * expected_depth(up) - p_short * expected_depth(down)) / 100


def recommendation(e: Column, r: Column, cleared: Column, gates: list[Column]) -> Column:
    grade = lambda a, b: F.when(e > 0, a).otherwise(b)
    return (
        F.when((F.abs(e) <= 0.05) | ~cleared, "Hold").when((F.abs(e) > 0.3) & (r < gates[0]), grade("Strong Buy", "Strong Sell"))
        .when((F.abs(e) > 0.15) & (r < gates[1]), grade("Buy", "Sell")).when(r < gates[2], grade("Accumulate", "Reduce")).otherwise("Hold")
    )


def quality_score(correct: Column, confidence: Column, b: Column, n: Column, depth_error: Column) -> Column:
    part = lambda x: F.greatest(F.lit(0.0), 1 - x)
    total = F.when(correct, 45.0).otherwise(0.0) + 25 * part(b / 2) + 20 * part(n / F.ln(F.lit(2.0))) + 10 * F.when(correct, confidence).otherwise(1 - confidence)
    return F.round(F.least(F.lit(100.0), total + F.when(depth_error.isNull(), 10.0).otherwise(10 * part(depth_error / 20))), 4)


def quality_flags(correct: Column, confidence: Column, h: Column, depth_error: Column, predicted: Column, actual: Column) -> Column:
    return F.array_compact(F.array(
        F.when(confidence < 0.45, F.lit("low_confidence")), F.when(h > 0.92 * max_entropy(2), F.lit("high_entropy")), F.when(~correct & (confidence >= 0.65), F.lit("calibration_mismatch")),
        F.when(depth_error >= 5, F.lit("large_return_error")), F.when(predicted != actual, F.lit("depth_mismatch")),
    ))


def laplace(count: Column, total: Column, k: int, alpha: float) -> Column:
    return (count + alpha) / (total + alpha * k)


def tempered(p: Column, t: Column) -> Column:
    """softmax(ln p / T) of an array of probabilities."""
    raised = F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(1e-12)), 1 / t))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def horizons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HORIZONS.items()), "horizon string, forward int")


def ideal_window(forward: Column) -> Column:
    """Bars of a training window that holds enough labelled rows and enough independent ones."""
    return forward + F.greatest(F.lit(MIN_ROWS), MIN_INDEPENDENT * forward)


def window_steps(forward: Column, history: Column) -> Column:
    """Training window in bars: the ideal one where it leaves enough bars to score, else at most half of the history."""
    ideal = ideal_window(forward)
    short = F.greatest(forward + MIN_TRAIN, F.least(ideal, F.floor(history / 2)))
    return F.when(ideal <= history - (1 + MIN_INDEPENDENT) * forward, ideal).otherwise(short)


def steps_of_days(days: Column, minutes: int) -> Column:
    return F.greatest(F.lit(1), F.bround(days * 1440 / minutes, 0).cast("long"))


def fitted_temperature_source(fitted: Column, carried: Column) -> Column:
    return F.when(fitted.isNotNull(), "fitted").when(carried.isNotNull(), "carried").otherwise("prior")


def quality_reason(status: Column, correct: Column, predicted: Column, actual: Column, confidence: Column, fwd_return: Column) -> Column:
    """The verdict of a quality row in words."""
    verdict = F.when(correct, "correct").otherwise("wrong")
    number = lambda x, pattern: F.call_function("format_number", x, F.lit(pattern))
    words = F.format_string("%s: said %s, came %s; %s%% sure, moved %s%%", verdict, predicted, actual, number(confidence * 100, "0.0"), number(fwd_return * 100, "0.00"))
    return F.when(status == "missing_target", "No bar yet at the horizon's end.").when(status == "scored", words)


def exposure_policy(raw: str | None) -> dict[str, float]:
    """`grade=share` pairs laid over the fixed shares; Hold, unknown grades and shares outside 0 to 1 are refused."""
    known = {k.lower().replace(" ", "_"): k for k in EXPOSURE}
    policy = dict(EXPOSURE)
    for part in filter(None, (x.strip() for x in (raw or "").split(","))):
        key, equals, value = part.partition("=")
        key = key.strip().lower().replace(" ", "_").replace("-", "_")
        if not equals or key not in known:
            raise ValueError(f"{part!r}: expected grade=share with one of {', '.join(sorted(known))}; Hold keeps what it finds and has no share")
        share = float(value)
        if not 0 <= share <= 1:
            raise ValueError(f"{part!r}: a share lies between 0 and 1")
        policy[known[key]] = share
    return policy


def bar_key(value: Column) -> Column:
    """A time in ISO form (with Z, an offset, fractions, or a date alone) as an instant; null for what is none."""
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))


def slug_parts(slug: Column) -> Column:
    """model, interval and run_ts of a run's slug; null for a name that is none or that has unsafe characters."""
    safe = slug.rlike(r"^[A-Za-z0-9][A-Za-z0-9-]*_[0-9]+[mhdw]_[0-9]{8}T[0-9]{6}$")
    part = lambda k: F.split_part(slug, F.lit("_"), F.lit(k))
    return F.when(safe, F.struct(part(1).alias("model"), part(2).alias("interval"), part(3).alias("run_ts")))


#: Intervals that names of stored runs may hold.
RUN_INTERVALS = ("1m", "1h", "1d", "1w")


def run_name(model: Column, run_ts: Column, interval: Column | None = None) -> Column:
    """The name of a run's folder, with its interval or in the older form without one; null where a part is empty or could name another folder."""
    parts = [model, *([interval] if interval is not None else []), run_ts]
    safe = [x.isNotNull() & (F.length(x) > 0) & ~x.rlike(r"[/\\\\]|\.\.") for x in parts]
    return F.when(reduce(lambda a, b: a & b, safe), F.concat_ws("_", *parts))


def run_parts(name: Column) -> Column:
    """model, interval and run_ts of a run's name that ends in at least 12 digits; null for others.

    With a known interval before the digits that interval is the run's, and a model that ends in it once more loses it; without one the
    name is of the older form: the model is the first part, the interval a day, the rest the time.
    """
    words = F.split(name, "_")
    n = F.size(words)
    known = (n >= 3) & F.try_element_at(words, F.lit(-2)).isin(*RUN_INTERVALS)
    interval = F.try_element_at(words, F.lit(-2))
    model = F.array_join(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), "_")
    twice = model.endswith(F.concat(F.lit("_"), interval)) & (F.length(model) > F.length(interval) + 1)
    model = F.when(twice, F.left(model, F.length(model) - F.length(interval) - 1)).otherwise(model)
    named = lambda m, i, t: F.struct(m.alias("model"), i.alias("interval"), t.alias("run_ts"))
    older = named(F.element_at(words, 1), F.lit("1d"), F.array_join(F.slice(words, F.lit(2), n), "_"))
    return F.when((n >= 2) & F.element_at(words, -1).rlike(r"^[0-9]{12,}$"), F.when(known, named(model, interval, F.element_at(words, -1))).otherwise(older))


def bin_lower(label: Column) -> Column:
    """Lower edge of a depth bin in percent, from its name."""
    return F.regexp_extract(label, r"^([0-9]+)", 1).try_cast("double")


def bin_midpoint(label: Column) -> Column:
    """Middle of a depth bin in percent; an open bin counts a quarter above its edge."""
    high = F.regexp_extract(label, r"-([0-9]+)$", 1).try_cast("double")
    return F.coalesce((bin_lower(label) + high) / 2, bin_lower(label) * 1.25)


def horizon_label(days: Column) -> Column:
    return F.when(days == 364, "1 year").when(days % 7 == 0, F.concat((days / 7).cast("int").cast("string"), F.when(days == 7, " week").otherwise(" weeks"))).otherwise(F.concat(days.cast("string"), F.lit(" days")))
