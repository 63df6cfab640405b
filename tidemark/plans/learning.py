"""Registered queries over walk-forward training: its rows, splits, scaling, models and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain as d
from ..operators import correlation, features, forecasts, learning
from ..sources.tables import BARS, daily_bars, settled
from .evaluation import LAB
from .market import FEATURES, RELATIVE, SHIFT, c, rounded, select

FOUND: dict = {}


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = (lambda spark, sf_dir: rounded(f(spark, sf_dir)), sql)
        return f

    return add


def pooled(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """The pool of all symbols and the columns that they share."""
    pool, names = learning.training_pool(settled(features.build(bars)), forecasts.labels(bars))
    return settled(pool), names


def labelled(bars: DataFrame) -> DataFrame:
    """Labels as pool rows without features."""
    return settled(forecasts.labels(bars).withColumn("slot", learning.slot(c("open_time"))))


ABSENT = ("realized_vol_1d", "max_intraday_drawdown", "jump_count")
F4 = f"{FEATURES}, f4 AS (SELECT *, {RELATIVE} FROM f3)"
COUNTS = " UNION ALL ".join(f"SELECT {k} AS place, '{n}' AS name, symbol, {'0' if n in ABSENT else f'count({n})'} AS n FROM f4 GROUP BY symbol" for k, n in enumerate(d.TRAINING_COLUMNS))


@query(f"WITH {F4}, cn AS ({COUNTS}) SELECT place, name, count_if(n > 0)::bigint AS symbols, count_if(n > 0) = count(*) AS shared FROM cn GROUP BY place, name")
def training_columns(spark, sf_dir):
    return learning.training_columns(features.build(daily_bars(spark, sf_dir)))


#: Slices of labelled rows by (month, horizon), for DuckDB: relations pn, sl.
SLICES = f"""{LAB}, nn AS (SELECT count(DISTINCT open_time) AS n FROM bi), hh AS (SELECT DISTINCT horizon, forward FROM lab),
pn AS (SELECT month, cutoff, horizon, forward, CASE WHEN forward + greatest(730, 3 * forward) <= n - 4 * forward THEN forward + greatest(730, 3 * forward) ELSE greatest(forward + 30, least(forward + greatest(730, 3 * forward), n // 2)) END AS steps
  FROM (SELECT date_trunc('month', open_time)::timestamp AS month, min(epoch(open_time) // 86400)::bigint AS cutoff FROM bi GROUP BY 1) CROSS JOIN hh CROSS JOIN nn),
la AS (SELECT *, (epoch(open_time) // 86400)::bigint AS slot FROM lab WHERE direction IS NOT NULL),
sl AS (SELECT pn.month, pn.horizon, pn.forward, la.symbol, la.slot, la.direction, row_number() OVER (PARTITION BY pn.month, pn.horizon ORDER BY la.slot, la.symbol) - 1 AS pos FROM pn JOIN la ON la.horizon = pn.horizon AND la.slot >= pn.cutoff - pn.steps AND la.slot < pn.cutoff - pn.forward)"""


@query(f"WITH {SLICES} SELECT month, horizon, symbol, count(*) AS rows FROM sl GROUP BY ALL")
def pool_contributions(spark, sf_dir):
    """Labelled rows that each symbol gives to each month's models."""
    bars = daily_bars(spark, sf_dir)
    return learning.contributions(labelled(bars), learning.plan(bars))


def splits(spark, sf_dir) -> DataFrame:
    bars = daily_bars(spark, sf_dir)
    return learning.holdouts(learning.days(labelled(bars), learning.plan(bars)))


SPLITS = f"""{SLICES}, dy AS (SELECT month, horizon, forward, slot, count(*) AS n, min(pos) AS pos FROM sl GROUP BY ALL),
fe AS (SELECT a.month, a.horizon, a.slot, a.pos, coalesce(sum(b.n), 0)::bigint AS fit_end FROM dy a LEFT JOIN dy b ON a.month = b.month AND a.horizon = b.horizon AND b.slot < a.slot - a.forward GROUP BY ALL),
fa AS (SELECT month, horizon, count(*) AS total, greatest(min(CASE WHEN direction = 'long' THEN pos END), min(CASE WHEN direction = 'short' THEN pos END)) AS both_from, least(max(CASE WHEN direction = 'long' THEN pos END), max(CASE WHEN direction = 'short' THEN pos END)) AS both_to, count(DISTINCT direction) AS kinds FROM sl GROUP BY 1, 2),
du AS (SELECT fa.*, dy.pos AS due_from FROM (SELECT *, CASE WHEN floor(total * 0.25) >= 40 THEN total - floor(total * 0.25) END::bigint AS due FROM fa) fa LEFT JOIN sl ON sl.month = fa.month AND sl.horizon = fa.horizon AND sl.pos = fa.due LEFT JOIN dy ON dy.month = fa.month AND dy.horizon = fa.horizon AND dy.slot = sl.slot),
cd AS (SELECT du.month, du.horizon, fe.pos, fe.fit_end, abs(fe.pos - due_from) AS far, fe.pos = due_from AND fe.fit_end > 0 AS due, kinds > 1 AND fe.fit_end > both_from AND fe.pos <= both_to AS good, fe.pos >= 1 AND fe.pos <= total - 40 AS room FROM du JOIN fe USING (month, horizon) WHERE due_from IS NOT NULL),
pk AS (SELECT month, horizon, bool_or(due) AS able, bool_or(due AND good) AS asked, min(CASE WHEN due THEN fit_end END) AS due_end, min(CASE WHEN due THEN pos END) AS due_pos, arg_min(pos, (far, pos)) FILTER (WHERE good AND room) AS near_pos, arg_min(fit_end, (far, pos)) FILTER (WHERE good AND room) AS near_end FROM cd GROUP BY 1, 2),
ho AS (SELECT du.month, du.horizon, total, coalesce(CASE WHEN able THEN CASE WHEN asked THEN due_end ELSE near_end END END, total) AS fit_end, coalesce(CASE WHEN able THEN CASE WHEN asked THEN due_pos ELSE near_pos END END, total) AS held_from, coalesce(able AND NOT asked AND near_pos IS NOT NULL, false) AS moved FROM du LEFT JOIN pk USING (month, horizon))"""


@query(f"WITH {SPLITS} SELECT month, horizon, total, fit_end, held_from FROM ho")
def holdout_split(spark, sf_dir):
    """Rows to fit and rows to hold out of each month's slice, a horizon apart."""
    return splits(spark, sf_dir).select("month", "horizon", "total", "fit_end", "held_from")


@query(f"WITH {SPLITS} SELECT horizon, count(*) AS months, count_if(moved)::bigint AS moved, count_if(held_from = total)::bigint AS whole FROM ho GROUP BY 1")
def usable_split(spark, sf_dir):
    """By horizon: splits moved so that both parts have two directions, and months that hold nothing out."""
    rows = splits(spark, sf_dir)
    return rows.groupBy("horizon").agg(F.count(F.lit(1)).alias("months"), F.count_if("moved").alias("moved"), F.count_if(c("held_from") == c("total")).alias("whole"))


SCALED = ["rsi_14", "log_return_1b", "rolling_vol_7", "volume_rel_30"]
WIDTH = 737


@query(select(
    f"{FEATURES}, ix AS (SELECT symbol, open_time, date_trunc('month', open_time)::timestamp AS month, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS idx, {', '.join(SCALED)} FROM f3), cu AS (SELECT symbol, month, min(idx) AS cutoff FROM ix GROUP BY 1, 2),"
    f" sx AS (SELECT cu.symbol, cu.month, {', '.join(f'quantile_cont(x.{n}, [0.25, 0.5, 0.75]) AS q_{n}' for n in SCALED)} FROM cu JOIN ix x ON x.symbol = cu.symbol AND x.idx < cu.cutoff AND x.idx >= cu.cutoff - {WIDTH} GROUP BY 1, 2),"
    f" sc AS (SELECT ix.symbol, ix.open_time, {', '.join(f'greatest(-5.0, least(5.0, CASE WHEN {n} IS NULL THEN 0.0 ELSE ({n} - coalesce(q_{n}[2], 0)) / coalesce(nullif(q_{n}[3] - q_{n}[1], 0), 1) END)) AS {n}' for n in SCALED)} FROM ix JOIN sx USING (symbol, month))",
    "sc", "symbol, open_time", ", ".join(SCALED),
))
def robust_scale(spark, sf_dir):
    """Features scaled by what the bars before their month hold."""
    bars = daily_bars(spark, sf_dir)
    return learning.robust_scale(features.build(bars), bars, SCALED, WIDTH)


LABS = LAB[len(BARS) :]  # labels, after the bars that FEATURES holds


@query(f"""WITH {FEATURES}{LABS}, sq AS (SELECT f3.symbol, f3.open_time, direction, list([coalesce(log_return_1b, 0)::double, coalesce(candle_range, 0)::double]) OVER (PARTITION BY f3.symbol ORDER BY f3.open_time ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS seq
 FROM f3 JOIN lab ON lab.symbol = f3.symbol AND lab.open_time = f3.open_time AND lab.horizon = 'week') SELECT symbol, open_time, direction, list_transform(flatten(seq), lambda x: round(x + {SHIFT}, 6) + 0.0) AS sequence FROM sq WHERE len(seq) = 8 AND direction IS NOT NULL""")
def sequence_windows(spark, sf_dir):
    """The eight returns and ranges before every labelled bar, at a week's horizon."""
    bars = daily_bars(spark, sf_dir)
    known = forecasts.labels(bars).where("horizon = 'week'").select("symbol", "open_time", "direction")
    rows = features.build(bars).select("symbol", "interval", "open_time", "log_return_1b", "candle_range").join(known, ["symbol", "open_time"])
    out = learning.sequence_windows(rows, ["log_return_1b", "candle_range"], 8)
    return out.select("symbol", "open_time", "direction", F.flatten("sequence").alias("sequence"))


# ---- models: boosting has no SQL; a test holds it to what it must find


@query()
def walk_forward(spark, sf_dir):
    """Monthly refits of the smaller learner at all horizons, calibrated."""
    bars = daily_bars(spark, sf_dir)
    return learning.walk_forward(*pooled(bars), learning.plan(bars))


def shares(pool, names, plan) -> DataFrame:
    """A forecaster that says what share of a slice's rows went up, one more of either kind added."""
    rows = learning.days(pool, plan).groupBy(*learning.WINDOW).agg(F.sum("longs").alias("longs"), F.sum("n").alias("n"))
    every = pool.withColumn("month", F.date_trunc("month", "open_time")).join(plan.select(*learning.WINDOW), learning.WINDOW).join(rows, learning.WINDOW, "left")
    p = F.when(c("n") >= learning.LEAST_ROWS, (c("longs") + 1) / (c("n") + 2)).otherwise(F.lit(0.5))
    return every.select("symbol", "horizon", "open_time", "month", F.coalesce(c("n") >= learning.LEAST_ROWS, F.lit(False)).alias("trained"), p.alias("p_long"), (1 - p).alias("p_short"))


@query(select(f"{SLICES}, sh AS (SELECT month, horizon, count(*) AS n, count_if(direction = 'long') AS longs FROM sl GROUP BY 1, 2), fs AS (SELECT la.symbol, la.horizon, la.open_time, coalesce(n >= 10, false) AS trained, CASE WHEN n >= 10 THEN (longs + 1) / (n + 2) ELSE 0.5 END AS p_long, 'shares' AS model FROM lab la LEFT JOIN sh ON sh.horizon = la.horizon AND sh.month = date_trunc('month', la.open_time)::timestamp)", "fs", "symbol, horizon, open_time, trained, model", "p_long, 1 - p_long AS p_short"))
def named_forecaster(spark, sf_dir):
    """A run of a forecaster that a user registers."""
    if "shares" not in learning.FORECASTERS:
        learning.register("shares", shares)
    bars = daily_bars(spark, sf_dir)
    return learning.forecast("shares", labelled(bars), [], learning.plan(bars)).select("symbol", "horizon", "open_time", "trained", "model", "p_long", "p_short")


@query()
def gbt_direction(spark, sf_dir):
    """Monthly refits of the larger learner at all horizons, before calibration."""
    bars = daily_bars(spark, sf_dir)
    made = learning.fitted(*pooled(bars), learning.plan(bars), learning.BOOSTED)
    return made.where("part in ('held', 'score', 'failed')").select("month", "horizon", "part", "symbol", "open_time", c("value").alias("p_long"), "is_long")


@query()
def depth_model(spark, sf_dir):
    """Depth bins of either side, modelled at all horizons."""
    bars = daily_bars(spark, sf_dir)
    return learning.depth_model(pooled(bars)[0], learning.plan(bars))


def last_month(spark, sf_dir) -> DataFrame:
    """Models of the last month of the bars, at work."""
    bars = daily_bars(spark, sf_dir)
    (pool, names), plan = pooled(bars), learning.plan(bars)
    newest = plan.agg(F.max("month").alias("month"))
    return learning.fitted(pool, names, plan.join(F.broadcast(newest), "month"), learning.BOOSTED)  # one row


@query()
def feature_importances(spark, sf_dir):
    return learning.feature_importances(last_month(spark, sf_dir))


@query()
def top_features(spark, sf_dir):
    """The 18 columns that the last model leant on most at a week's horizon."""
    rows = learning.feature_importances(last_month(spark, sf_dir)).where("horizon = 'week'")
    return rows.orderBy(c("importance").desc(), "name").limit(18)


@query()
def run_summary(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    (pool, names), plan, known = pooled(bars), learning.plan(bars), forecasts.labels(bars)
    return learning.run_summary(settled(learning.walk_forward(pool, names, plan)), plan, learning.holdouts(learning.days(pool, plan)), known, correlation.return_correlation(known))


@query()
def window_failures(spark, sf_dir):
    """Months that could not be fitted, of a run over windows that are too short to hold two directions at every horizon: fits that failed, and slices without rows."""
    bars = daily_bars(spark, sf_dir)
    (pool, names), plan = pooled(bars), learning.plan(bars, days=400)
    out = learning.window_failures(learning.fitted(pool, names, plan, (2, 2, 0.1)), plan, learning.holdouts(learning.days(pool, plan)), "days400")
    return out.select("run", "failed", F.to_json("by_horizon").alias("by_horizon"), F.to_json("by_stage").alias("by_stage"), "first")


def queries() -> dict:
    return {k: v[0] for k, v in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in FOUND.items() if v[1]}
