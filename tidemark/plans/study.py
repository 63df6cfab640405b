"""Registered queries that compare runs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain as d
from ..operators import correlation, forecasts, significance, study
from ..sources.tables import settled
from . import evaluation
from .evaluation import COUNTED, HISTORY, LEAN, TWO, lean_sql, several
from .market import c, rounded, select

FOUND: dict = {}
#: Runs (model, seed, smoothing): one that learns nothing, one that no seed changes, and one that a seed does.
RUNS = [("baseline", 7, 1.0), ("a2", 7, 2.0), ("a2", 42, 2.0), ("a20", 7, 20.0), ("a20", 42, 40.0)]
SEEDS = [7, 42]


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = (lambda spark, sf_dir: rounded(f(spark, sf_dir)), sql)
        return f

    return add


def quality(spark, sf_dir) -> DataFrame:
    """What comparisons need of the runs' quality rows."""
    rows = forecasts.scored(forecasts.several(evaluation.labels(spark, sf_dir), RUNS))
    return settled(rows.select("symbol", "model", "seed", "horizon", "forward", "idx", "open_time", "status", "confidence", "correct", "brier", "nll"))


def cells(spark, sf_dir) -> DataFrame:
    return study.cells(quality(spark, sf_dir))


def intervals(rows: DataFrame) -> DataFrame:
    return significance.mean_interval(significance.hits(rows, study.RUN), keys=study.RUN)


SQ = f"{COUNTED}, {several('rn', RUNS)}, {lean_sql('rn', 'q')}"
CELLS = f"{SQ}, ce AS (SELECT symbol, model, seed, horizon, count(*) AS n, avg(correct::int) AS accuracy, avg(confidence) AS confidence, avg(brier) AS brier, avg(nll) AS nll FROM q WHERE status = 'scored' GROUP BY 1, 2, 3, 4)"
INVARIANT = """sk AS (SELECT symbol, model, seed, md5(string_agg(horizon || n || round(accuracy, 9) || round(confidence, 9) || round(brier, 9) || round(nll, 9), ';' ORDER BY horizon)) AS k FROM ce GROUP BY 1, 2, 3),
iv AS (SELECT symbol, model, count(*) AS runs, min(seed) AS first FROM sk GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT k) = 1), di AS (SELECT ce.* FROM ce LEFT JOIN iv USING (symbol, model) WHERE first IS NULL OR seed = first)"""
HIT = "hit AS (SELECT symbol, model, seed, horizon, forward, row_number() OVER (PARTITION BY symbol, model, seed, horizon ORDER BY idx) - 1 AS pos, correct::int AS x FROM q WHERE status = 'scored')"
BOUNDS = f"{HIT}, {significance.boot_sql('hit', 'bo', 'symbol, model, seed, horizon', 'x', 'avg(x)', 'S(x) / max(n)')}"


@query(f"WITH {CELLS}, {INVARIANT} SELECT symbol, model, runs, first FROM iv")
def seed_invariant(spark, sf_dir):
    runs = cells(spark, sf_dir)
    found = study.seed_invariant(runs)
    return runs.groupBy("symbol", "model").agg(F.count_distinct("seed").alias("runs")).join(found, ["symbol", "model"]).select("symbol", "model", "runs", "first")


@query(select(f"{CELLS}, {INVARIANT}", "di", "symbol, model, seed, horizon, n", "accuracy"))
def distinct_runs(spark, sf_dir):
    runs = cells(spark, sf_dir)
    return study.distinct_runs(runs, study.seed_invariant(runs)).select("symbol", "model", "seed", "horizon", "n", "accuracy")


@query(select(f"""{CELLS}, {INVARIANT}, m AS (SELECT horizon, model, avg(accuracy) AS mean FROM ce GROUP BY 1, 2), no AS (SELECT horizon, avg(sd) AS noise FROM (SELECT horizon, symbol, model, stddev_samp(accuracy) AS sd FROM ce ANTI JOIN iv USING (symbol, model) GROUP BY 1, 2, 3) GROUP BY 1),
s AS (SELECT horizon, count(*) AS models, max(mean) - min(mean) AS spread, max(CASE WHEN model <> 'baseline' THEN mean END) - min(CASE WHEN model <> 'baseline' THEN mean END) AS spread_learners FROM m GROUP BY 1), sn AS (SELECT * FROM s LEFT JOIN no USING (horizon))""", "sn", "horizon, models", "spread, spread_learners, noise"))
def architecture_spread(spark, sf_dir):
    return study.architecture_spread(cells(spark, sf_dir))


PLACES = "m AS (SELECT horizon, model, avg(accuracy) AS mean FROM ce WHERE model <> 'baseline' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY round(mean, 9) DESC, model) AS place FROM m)"


@query(select(f"{CELLS}, {PLACES}, pc AS (SELECT a.horizon, b.horizon AS other, corr(a.place, b.place) AS r FROM r a JOIN r b ON a.model = b.model AND a.horizon < b.horizon GROUP BY 1, 2), o AS (SELECT count(r) AS pairs, avg(r) AS correlation FROM pc)", "o", "pairs", "correlation"))
def rank_agreement(spark, sf_dir):
    return study.rank_agreement(cells(spark, sf_dir))


@query(select(f"{CELLS}, {PLACES}, a AS (SELECT model, avg(place) AS mean_place, min(place) AS best, max(place) AS worst FROM r GROUP BY 1)", "a", "model, best, worst", "mean_place"))
def rank_places(spark, sf_dir):
    return study.rank_places(cells(spark, sf_dir))


@query(select(f"{CELLS}, {INVARIANT}, {BOUNDS}, f AS (SELECT di.horizon, count(*) AS runs, min(accuracy) AS least, max(accuracy) AS most, count(low) AS estimable, count(*) FILTER (WHERE low > 0.5) AS above, count(*) FILTER (WHERE high < 0.5) AS below FROM di LEFT JOIN bo ON di.symbol = bo.symbol AND di.model = bo.model AND di.seed = bo.seed AND di.horizon = bo.horizon GROUP BY 1)", "f", "horizon, runs, estimable, above, below", "least, most"))
def study_facts(spark, sf_dir):
    rows = quality(spark, sf_dir)
    return study.study_facts(study.cells(rows), intervals(rows))


@query(select(f"{CELLS}, {BOUNDS}, b AS (SELECT horizon, max((round(accuracy, 9), symbol, model, seed)) AS b FROM ce GROUP BY 1), u AS (SELECT horizon, b[2] AS symbol, b[3] AS model, b[4] AS seed, b[1] AS accuracy FROM b), ub AS (SELECT u.*, low, high FROM u LEFT JOIN bo USING (horizon, symbol, model, seed))", "ub", "horizon, symbol, model, seed", "accuracy, low, high"))
def best_cell(spark, sf_dir):
    rows = quality(spark, sf_dir)
    return study.best_cell(study.cells(rows), intervals(rows))


CURVE = """cb AS (SELECT symbol, model, seed, horizon, least(9, floor(confidence * 10))::int AS bin, count(*) AS n, abs(avg(correct::int) - avg(confidence)) AS gap FROM q WHERE status = 'scored' GROUP BY 1, 2, 3, 4, 5),
ec AS (SELECT symbol, model, seed, horizon, sum(n * gap) / sum(n) AS ece FROM cb GROUP BY 1, 2, 3, 4)"""


@query(select(f"{CELLS}, {CURVE}, {HISTORY}, mw AS (SELECT horizon, forward, quantile_cont(steps, 0.5) AS width FROM ws GROUP BY 1, 2), cf AS (SELECT model, horizon, avg(ece) AS ece, avg(confidence) AS confidence, avg(accuracy) AS hit_rate FROM ce JOIN ec USING (symbol, model, seed, horizon) GROUP BY 1, 2), cw AS (SELECT *, 0.25 * (width - forward) / forward AS slice_observations FROM cf JOIN mw USING (horizon))", "cw", "model, horizon", "ece, confidence, hit_rate, width AS median_window, slice_observations"))
def calibration_facts(spark, sf_dir):
    rows = quality(spark, sf_dir)
    windows = evaluation.history(spark, sf_dir).withColumn("steps", d.window_steps(c("forward"), c("n")).cast("double"))
    return study.calibration_facts(study.cells(rows), forecasts.ece(rows, study.RUN), windows).withColumnRenamed("window", "median_window")


@query(select(f"{SQ}, rb AS (SELECT horizon, model, len(list_filter({list(study.EDGES)}, lambda e: e <= confidence)) AS k, confidence, correct FROM q WHERE status = 'scored'), rr AS (SELECT horizon, model, k, count(*) AS n, avg(confidence) AS mean_confidence, avg(correct::int) AS accuracy FROM rb WHERE k BETWEEN 1 AND {len(study.EDGES) - 1} GROUP BY 1, 2, 3 HAVING count(*) >= {study.LEAST_IN_BIN}), rl AS (SELECT *, ({list(study.EDGES)})[k] AS low, ({list(study.EDGES)})[k + 1] AS high FROM rr)", "rl", "horizon, model, n", "low, high, mean_confidence, accuracy"))
def reliability(spark, sf_dir):
    return study.reliability(quality(spark, sf_dir), ["horizon", "model"])


STATUS = """bh AS (SELECT symbol, model, seed, horizon, count(*) AS rows, count_if(status = 'scored') AS samples, avg(CASE WHEN status = 'scored' THEN quality_score END) AS score FROM q GROUP BY 1, 2, 3, 4),
bs AS (SELECT symbol, model, seed, sum(rows)::bigint AS rows, sum(samples)::bigint AS samples, sum(samples * score) / nullif(sum(samples), 0) AS model_score FROM bh GROUP BY 1, 2, 3),
ba AS (SELECT *, CASE WHEN samples > 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN samples = 0 THEN 'no scored row' END AS error, coalesce(model_score < 50, false) AS alert FROM bs)"""


@query(select(f"{TWO}, {STATUS}", "ba", "symbol, model, seed, rows, samples, status, error, alert", "model_score"))
def batch_status(spark, sf_dir):
    rows = forecasts.scored(evaluation.two_models(spark, sf_dir))
    return study.batch_status(rows, ["symbol", "model", "seed"])


PANEL = f"""o1 AS (SELECT symbol, model, seed, horizon, forward, open_time::date AS date, correct::int AS hit, nll FROM q WHERE status = 'scored'), sg AS (SELECT symbol, model FROM o1 GROUP BY 1, 2 HAVING count(DISTINCT seed) = 1),
sd AS (SELECT symbol, model, unnest({SEEDS}) AS seed FROM sg), o2 AS (SELECT o1.* FROM o1 ANTI JOIN sg USING (symbol, model) UNION ALL BY NAME SELECT o1.* REPLACE (sd.seed AS seed) FROM o1 JOIN sd USING (symbol, model)),
pd AS (SELECT a.horizon, a.model AS first, b.model AS second, a.forward, a.date, a.symbol, a.seed, a.hit - b.hit AS dh, a.nll - b.nll AS dl FROM o2 a JOIN o2 b USING (symbol, seed, horizon, date) WHERE a.model < b.model),
dy0 AS (SELECT horizon, first, second, forward, date, sum(dh)::double AS acc, sum(dl) AS lss, count(*)::double AS cells FROM pd GROUP BY ALL), dy AS (SELECT *, row_number() OVER (PARTITION BY horizon, first, second ORDER BY date) - 1 AS pos FROM dy0),
pc AS (SELECT horizon, first, second, count(DISTINCT (symbol, seed)) AS panel_cells FROM pd GROUP BY ALL)"""
_DIFF = [significance.boot_sql("dy", name, "horizon, first, second", f"{v}, cells", f"sum({v}) / sum(cells)", f"S({v}) / S(cells)", 0.0) for name, v in (("pa", "acc"), ("pl", "lss"))]
DIFFERENCES = f"{PANEL}, {', '.join(_DIFF)}, pu AS (SELECT 'accuracy' AS measure, * FROM pa UNION ALL SELECT 'log_loss', * FROM pl), {significance.bh_sql('pu', 'pq', 'horizon, first, second', 'measure')}, pz AS (SELECT pu.*, panel_cells, q_value FROM pu JOIN pc USING (horizon, first, second) LEFT JOIN pq USING (measure, horizon, first, second))"


@query(select(f"{SQ}, {DIFFERENCES}".replace("LEFT JOIN pq USING (measure, horizon, first, second)", "LEFT JOIN (SELECT measure, horizon, first, second, q_value FROM pq) USING (measure, horizon, first, second)"), "pz", "horizon, first, second, measure, n, panel_cells, resamples", "value, low, high, p_value, q_value"))
def paired_differences(spark, sf_dir):
    return significance.paired_differences(quality(spark, sf_dir), SEEDS)


DRAWS, PRECISE = 500, 1000
_RUN = "symbol, model, seed, horizon"
_P = [significance.boot_sql(source, name, _RUN, "x", "avg(x)", "S(x) / max(n)", resamples=n, stretch=k) for source, name, n, k in (("dh", "d0", significance.RESAMPLES, 1), ("dh", "d1", DRAWS, 1), ("ds", "d2", PRECISE, 1), ("ds", "d3", DRAWS, 2))]
DRAWN = f"""{CELLS}, {INVARIANT}, {HIT}, dh AS (SELECT hit.* FROM hit SEMI JOIN di USING ({_RUN})), {_P[0]}, {_P[1]},
dt AS (SELECT d0.symbol, d0.model, d0.seed, d0.horizon, d0.n, d0.value, d0.low, d0.high, d1_q.p AS p_value FROM d0 JOIN d1_q USING ({_RUN}) WHERE d0.low IS NOT NULL), {significance.bh_sql('dt', 'dq', _RUN)},
ds AS (SELECT dh.* FROM dh SEMI JOIN (SELECT {_RUN} FROM dq WHERE q_value < {significance.DISCOVERIES}) USING ({_RUN})), {_P[2]}, {_P[3]},
dz AS (SELECT dq.* EXCLUDE (raw), d2_q.p AS p_precise, d3_q.p AS p_double_block FROM dq LEFT JOIN d2_q USING ({_RUN}) LEFT JOIN d3_q USING ({_RUN})),
du AS (SELECT {_RUN}, coalesce(p_precise, p_value) AS p_value FROM dz), {significance.bh_sql('du', 'dr', _RUN)},
de AS (SELECT dz.*, CASE WHEN p_precise IS NOT NULL THEN dr.q_value END AS q_precise FROM dz JOIN (SELECT {_RUN}, q_value FROM dr) dr USING ({_RUN}))"""


@query(select(DRAWN, "de", f"{_RUN}, n", "value, low, high, p_value, q_value, p_precise, p_double_block, q_precise"))
def departures_drawn(spark, sf_dir):
    """As `departures`, with fewer draws."""
    rows = quality(spark, sf_dir)
    some = study.distinct_runs(rows, study.seed_invariant(study.cells(rows)))
    return significance.departures(significance.hits(some, study.RUN), study.RUN, DRAWS, PRECISE)


@query()
def departures(spark, sf_dir):
    """Every distinct run and horizon against chance, with q-values, and the survivors drawn again."""
    rows = quality(spark, sf_dir)
    runs = study.cells(rows)
    some = study.distinct_runs(rows, study.seed_invariant(runs))
    return significance.departures(significance.hits(some, study.RUN), study.RUN)


LAG = f"""{LEAN}, s0 AS (SELECT horizon, symbol, open_time, fwd_return, correct::int AS hit FROM q WHERE status = 'scored'), al AS (SELECT horizon, open_time FROM s0 GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM s0)), s1 AS (SELECT * FROM s0 SEMI JOIN al USING (horizon, open_time)),
pr AS (SELECT a.horizon, a.symbol AS s1, b.symbol AS s2, count(*) AS n, corr(a.fwd_return, b.fwd_return) AS rr, corr(a.hit, b.hit) AS rh FROM s1 a JOIN s1 b ON a.horizon = b.horizon AND a.open_time = b.open_time AND a.symbol < b.symbol GROUP BY 1, 2, 3), pm AS (SELECT horizon, max(n) AS dates, avg(rr) AS rho_returns, avg(rh) AS rho_hits FROM pr GROUP BY 1),
ch AS (SELECT horizon, symbol, (predicted IS DISTINCT FROM lag(predicted) OVER (PARTITION BY symbol, horizon ORDER BY idx))::int AS change FROM q WHERE status = 'scored'), ho AS (SELECT horizon, avg(len) AS hold FROM (SELECT horizon, symbol, count(*) / sum(change) AS len FROM ch GROUP BY 1, 2) GROUP BY 1), bl AS (SELECT * FROM pm JOIN ho USING (horizon))"""


@query(select(LAG, "bl", "horizon, dates", "rho_returns, rho_hits, hold"))
def baseline_lag(spark, sf_dir):
    """How long the baseline holds a side, and how much the symbols share in returns and in hits."""
    rows = settled(evaluation.quality(spark, sf_dir).where("status = 'scored'").select(*forecasts.HKEYS, "idx", "open_time", "predicted", "fwd_return", c("correct").cast("double").alias("hit")))
    rho = [correlation.common_correlation(rows, value, ["horizon"]).withColumnRenamed("correlation", name) for value, name in (("fwd_return", "rho_returns"), ("hit", "rho_hits"))]
    runs = evaluation.side_lengths(rows).groupBy("horizon").agg(F.avg("mean_length").alias("hold"))
    return rho[0].join(rho[1].drop("dates"), "horizon").join(runs, "horizon")


def queries() -> dict:
    return {k: v[0] for k, v in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in FOUND.items() if v[1]}
