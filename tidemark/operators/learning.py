"""Walk-forward learners: every month's models are fitted on pooled rows whose labels were known before its first bar.

A run is one job: labelled rows are dealt to the months whose windows hold them, splits are found with window functions, and each
(month, horizon), whose size its window bounds, is fitted in a task of its own. Temperatures are fitted on the held-out rows and
applied as table operations. Months and horizons that can't be fitted have rows that say so.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain as d
from ..sources.tables import settled
from . import boosting, study
from .calibration import calibrate, fit_temperature, temperature_memory
from .series import beside, carried, dealt, indexed

c = F.col
WINDOW = ["month", "horizon"]
LEAST_ROWS = 10


# ---- rows and windows


def training_columns(features: DataFrame) -> DataFrame:
    """place, name, symbols (that have values of it), shared (all of them do), for every column that models are trained on."""
    names = list(d.TRAINING_COLUMNS)
    by = features.groupBy("symbol").agg(*[F.count(x).alias(x) for x in names])
    each = by.select("symbol", F.posexplode(F.array(*[F.struct(F.lit(x).alias("name"), c(x).alias("n")) for x in names])).alias("place", "x"))
    out = each.groupBy("place", "x.name").agg(F.count_if(c("x.n") > 0).alias("symbols"), F.count(F.lit(1)).alias("pool"))
    return out.select("place", "name", "symbols", (c("symbols") == c("pool")).alias("shared"))


def training_pool(features: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """(symbol, open_time, slot, horizon, forward, x, direction, depth_bin) of all symbols of a pool, and the columns that all of them have.

    Labels are made inside each symbol. Refused where the symbols share no column.
    """
    shared = [r["name"] for r in training_columns(features).where("shared").orderBy("place").collect()]  # one row a column
    if not shared:
        raise ValueError("the symbols of the pool share no training column")
    x = features.select("symbol", "open_time", F.array(*[c(n).cast("double") for n in shared]).alias("x"))
    known = labels.select("symbol", "open_time", "horizon", "forward", "direction", "depth_bin")
    return known.join(x, ["symbol", "open_time"]).withColumn("slot", slot(c("open_time"))), shared


def slot(at: Column, minutes: int = 1440) -> Column:
    """The number of an interval since the epoch: a pool's rows are bounded by instants, not by row numbers."""
    return F.floor(F.unix_seconds(at) / (60 * minutes)).cast("long")


def resolve_windows(history: DataFrame, interval: str = "1d", days: int | None = None, overrides: dict[str, int] | None = None, strict: bool = False) -> DataFrame:
    """history (symbol, horizon, forward, n) with steps, window_days, usable: an override in days, else the shared days, else derived.

    usable is false where the window leaves fewer than MIN_TRAIN labelled rows; strict raises with those horizons instead.
    """
    minutes = d.INTERVALS[interval]
    given = F.create_map(*[F.lit(x) for k, v in (overrides or {}).items() for x in (k, v)]) if overrides else F.create_map().cast("map<string,int>")
    chosen = F.coalesce(F.try_element_at(given, c("horizon")), F.lit(days).cast("int"))
    steps = F.when(chosen.isNotNull(), d.steps_of_days(chosen, minutes)).otherwise(d.window_steps(c("forward"), c("n"))).cast("long")
    out = history.withColumn("steps", steps).withColumns({"window_days": F.bround(c("steps") * minutes / 1440, 0).cast("long"), "usable": c("steps") - c("forward") >= d.MIN_TRAIN})
    out = out.withColumn("least_days", F.when(~c("usable"), F.floor((c("forward") + d.MIN_TRAIN) * minutes / 1440).cast("long") + 1))
    if strict and (short := out.where("not usable").select("horizon", "least_days").distinct().orderBy("horizon").collect()):
        raise ValueError("training windows are too small: " + ", ".join(f"{r['horizon']} needs {r['least_days']} days" for r in short))
    return out


def plan(bars: DataFrame, horizons: dict[str, int] = d.HORIZONS, first: str | None = None, days: int | None = None) -> DataFrame:
    """month, horizon, cutoff (slot of the month's first bar), forward, steps: what each month's models may look back on."""
    rows = bars.where(c("open_time") >= F.lit(first).cast("timestamp")) if first else bars
    months = rows.groupBy(F.date_trunc("month", "open_time").alias("month")).agg(F.min(slot(c("open_time"))).alias("cutoff"))
    n = bars.agg(F.count_distinct("open_time").alias("n"))
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("forward")) for h, k in horizons.items()])
    widths = resolve_windows(n.select(F.explode(each).alias("h"), "n").select("h.horizon", "h.forward", "n"), days=days)
    return months.crossJoin(F.broadcast(widths.select("horizon", "forward", "steps")))  # one row a horizon


def month_of(n: Column) -> Column:
    return F.date_trunc("month", F.timestamp_seconds(n * 86400))


def days(pool: DataFrame, plan: DataFrame) -> DataFrame:
    """month, horizon, slot, n, longs of the days that hold labelled rows of a slice: cutoff - W <= slot < cutoff - F.

    Symbols are added up before days are dealt to the months in which their window can lie, so what is dealt is days, not rows.
    """
    wide = plan.groupBy("horizon").agg(F.max("steps").alias("widest"), F.max("forward").alias("forward"))
    by = pool.where("direction is not null").groupBy("horizon", "slot").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("direction") == "long").alias("longs"))
    by = by.join(F.broadcast(wide), "horizon")  # one row a horizon
    by = by.withColumn("month", F.explode(F.sequence(month_of(c("slot") + c("forward") + 1), month_of(c("slot") + c("widest")), F.expr("interval 1 month")))).drop("widest", "forward")
    return by.join(plan, WINDOW).where((c("slot") >= c("cutoff") - c("steps")) & (c("slot") < c("cutoff") - c("forward"))).select(*WINDOW, "forward", "slot", "n", "longs")


def contributions(pool: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows that each symbol gives to each month's slices: running counts, read where a window begins and where it ends."""
    counts = pool.where("direction is not null").groupBy("symbol", "horizon", "slot").agg(F.count(F.lit(1)).alias("n"))
    ends = plan.select(*WINDOW, F.explode(F.array(F.struct(F.lit(-1).alias("sign"), (c("cutoff") - c("steps")).alias("slot")), F.struct(F.lit(1).alias("sign"), (c("cutoff") - c("forward")).alias("slot")))).alias("e")).select(*WINDOW, "e.*")
    probes = counts.select("symbol", "horizon").distinct().join(ends, "horizon").select("symbol", "horizon", "slot", "month", "sign", F.lit(0).cast("long").alias("n"))
    both = probes.unionByName(counts, allowMissingColumns=True).withColumn("at", 2 * c("slot") + c("month").isNull().cast("long"))  # probes see the days before
    read = carried(both, "sum", {"upto": c("n")}, ["symbol", "horizon"], "at").where("month is not null")
    return read.groupBy(*WINDOW, "symbol").agg(F.sum(c("upto") * c("sign")).alias("rows")).where("rows > 0")


def holdouts(by: DataFrame) -> DataFrame:
    """month, horizon, total, fit_end, held_from, moved, fit_before, held_slot of days (month, horizon, forward, slot, n, longs).

    The newest HELD_OUT share of a slice's rows is held out from the first row of its day, and fitted rows end more than a horizon before
    it. Where either part has one direction only, the nearest day at which both have two is taken; where there is none, or fewer than
    LEAST_FITTED rows would be held out, all rows are fitted and none is held out (fit_end = held_from = total, the slots null).
    Rows are counted by day, so a window here spans the days of a slice, whatever the number of symbols.
    """
    w = Window.partitionBy(*WINDOW).orderBy("slot")
    upto = w.rangeBetween(Window.unboundedPreceding, -1)
    older = None  # rows more than a horizon older than each day
    kinds = [r["forward"] for r in by.select("forward").distinct().orderBy("forward").collect()]  # one row a horizon
    for k in kinds:
        n = F.coalesce(F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, -(k + 1))), F.lit(0))
        older = F.when(c("forward") == k, n) if older is None else older.when(c("forward") == k, n)
    rows = by.withColumns({"pos": F.coalesce(F.sum("n").over(upto), F.lit(0)), "fit_end": F.lit(0).cast("long") if older is None else older, "up": c("longs") > 0, "down": c("longs") < c("n")})
    at = lambda pick, side: pick(F.when(c(side), c("pos")))
    facts = rows.groupBy(*WINDOW).agg(F.sum("n").alias("total"), F.greatest(at(F.min, "up"), at(F.min, "down")).alias("both_from"), F.least(at(F.max, "up"), at(F.max, "down")).alias("both_to"), (F.max("up") & F.max("down")).alias("two"))
    held = F.floor(c("total") * d.HELD_OUT)
    met = rows.join(facts.withColumn("due", F.when(held >= d.LEAST_FITTED, c("total") - held)), WINDOW)
    whole = met.where((c("pos") <= c("due")) & (c("due") < c("pos") + c("n"))).select(*WINDOW, c("pos").alias("due_from"))
    starts = met.join(whole, WINDOW)
    good = c("two") & (c("fit_end") > c("both_from")) & (c("pos") <= c("both_to"))
    due = (c("pos") == c("due_from")) & (c("fit_end") > 0)  # by time alone; where the gap leaves nothing to fit, nothing is held out
    room = (c("pos") >= 1) & (c("pos") <= c("total") - d.LEAST_FITTED)
    split = F.struct(F.abs(c("pos") - c("due_from")).cast("long").alias("far"), "pos", "fit_end", (c("slot") - c("forward")).alias("fit_before"), "slot")
    chosen = starts.groupBy(*WINDOW).agg(F.min(F.when(due & good, split)).alias("asked"), F.min(F.when(room & good, split)).alias("near"), F.max(due.cast("int")).alias("able"))
    out = facts.join(chosen.select(*WINDOW, F.when(c("able") == 1, F.coalesce("asked", "near")).alias("pick")), WINDOW, "left")
    return out.select(*WINDOW, "total", F.coalesce("pick.fit_end", "total").alias("fit_end"), F.coalesce("pick.pos", "total").alias("held_from"), F.coalesce(c("pick.far") > 0, F.lit(False)).alias("moved"), "pick.fit_before", c("pick.slot").alias("held_slot"))


# ---- scaling and sequences


def robust_scale(features: DataFrame, bars: DataFrame, names: list[str], width: int) -> DataFrame:
    """symbol, open_time and the named columns, scaled by the median and interquartile range of the `width` bars before their month.

    Missing values become 0 after scaling, infinities 3, all lies within 5; a column without values or spread is scaled by 1 around 0.
    A month with no bar before it has no rows.
    """
    rows = indexed(features.select("symbol", "interval", "open_time", *[c(n).cast("double") for n in names])).withColumn("month", F.date_trunc("month", "open_time"))
    first = rows.groupBy("symbol", "month").agg(F.min("idx").alias("cutoff"))
    # A month's window in rows: bars are met by blocks of `width` rows, of which a window touches two.
    block = lambda x: F.floor(x / width)
    ends = first.where("cutoff > 0").withColumn("block", F.explode(F.array_distinct(F.array(block(F.greatest(c("cutoff") - width, F.lit(0))), block(c("cutoff") - 1)))))
    seen = rows.withColumn("block", block(c("idx"))).drop("month").join(ends, ["symbol", "block"]).where((c("idx") < c("cutoff")) & (c("idx") >= c("cutoff") - width))
    finite = lambda n: F.when(F.abs(n) < float("inf"), c(n))
    stats = seen.groupBy("symbol", "month").agg(*[F.percentile(finite(n), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{n}") for n in names])

    def scaled(n: str) -> Column:
        q = c(f"q_{n}")
        spread = F.coalesce(F.nullif(q[2] - q[0], F.lit(0.0)), F.lit(1.0))
        z = (c(n) - F.coalesce(q[1], F.lit(0.0))) / spread
        z = F.when(c(n).isNull() | F.isnan(n), 0.0).when(c(n) == float("inf"), 3.0).when(c(n) == float("-inf"), -3.0).otherwise(z)
        return F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)).alias(n)

    return rows.join(stats, ["symbol", "month"]).select("symbol", "open_time", *[scaled(n) for n in names])


def sequence_windows(rows: DataFrame, names: list[str], length: int) -> DataFrame:
    """rows (symbol, interval, open_time, direction, names) that are labelled and have `length` bars before them, with those bars' vectors in order."""
    w = lambda spec: F.collect_list(F.array(*[F.coalesce(c(n), F.lit(0.0)) for n in names])).over(spec.rowsBetween(-length, -1))
    out = beside(indexed(rows), {"sequence": w}, ["symbol", "interval"], "idx", back=length)
    return out.where((F.size("sequence") == length) & c("direction").isNotNull()).select("symbol", "open_time", "direction", "sequence")


# ---- models


#: Trees, depth and rate of the two learners, and of the depth model.
ML, BOOSTED, DEPTHS = (50, 4, 0.1), (100, 6, 0.1), (30, 3, 0.1)
#: Rows of a month and horizon that one task bins, columns left as they are.
BINNED_ROWS = 50_000
_OUT = "month timestamp, horizon string, part string, symbol string, open_time timestamp, name string, value double, is_long boolean"


#: Shares of a column's rows at which its bins end, and the median.
_CUTS = np.append(np.linspace(0, 1, boosting.BINS + 1)[1:-1], 0.5)


def _edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bin edges and medians by column, of the quantiles of a model's months, each weighing as many rows as it has."""
    pdf = pdf.sort_values(["place", "block"])
    place, n, points = (pdf[x].to_numpy() for x in ("place", "n", "points"))
    sizes = np.array([0 if x is None else len(x) for x in points])
    edges, middle, ends = [], [], np.flatnonzero(np.diff(place, append=place[-1:] + 1)) + 1
    for first, last in zip([0, *ends[:-1]], ends, strict=True):
        there = np.flatnonzero(sizes[first:last]) + first
        if not len(there):
            edges.append([])
            middle.append(0.0)
            continue
        value, weight = np.concatenate(points[there]).astype(float), np.repeat(n[there] / sizes[there], sizes[there])
        order = np.argsort(value, kind="stable")
        value, upto = value[order], np.cumsum(weight[order])
        at = value[np.minimum(np.searchsorted(upto, _CUTS * upto[-1], "left"), len(value) - 1)]
        edges.append(np.unique(at[:-1]).tolist())
        middle.append(float(at[-1]))
    return pdf[WINDOW].iloc[:1].assign(edges=[edges], middle=[middle])


def _spans(plan: DataFrame) -> DataFrame:
    """plan with the first and last month of the rows that each model looks back on."""
    return plan.withColumns({"first": month_of(c("cutoff") - c("steps")), "last": month_of(c("cutoff") - c("forward") - 1)})


def _blocks() -> Column:
    """The months of a model's rows: those that it looks back on, and its own."""
    return F.array_distinct(F.concat(F.when(c("first") <= c("last"), F.sequence("first", "last", F.expr("interval 1 month"))).otherwise(F.array()), F.array("month")))


def models(pool: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with block (first and last month of the rows looked back on), edges and middle: bins from the quantiles of those months.

    Quantiles are taken by month of the pool, once, and put together by model; all those rows stand before the cutoff.
    """
    spans = _spans(plan)
    columns = F.posexplode("x").alias("place", "v")
    finite = F.when(F.abs("v") < float("inf"), c("v"))
    sketch = pool.withColumn("block", month_of(c("slot"))).select("horizon", "block", columns).withColumn("v", finite).groupBy("horizon", "block", "place")
    quantiles = [(k + 0.5) / boosting.BINS for k in range(boosting.BINS)]
    sketch = settled(sketch.agg(F.percentile_approx("v", quantiles, 10_000).alias("points"), F.count("v").alias("n")))
    back = spans.where(c("first") <= c("last")).withColumn("block", F.explode(F.sequence("first", "last", F.expr("interval 1 month"))))
    met = back.select(*WINDOW, "block").join(sketch, ["horizon", "block"])
    edges = met.groupBy(*WINDOW).applyInPandas(_edges, "month timestamp, horizon string, edges array<array<double>>, middle array<double>")
    return spans.join(edges, WINDOW)


def _binning(rows: pd.DataFrame, plans: pd.DataFrame) -> pd.DataFrame:
    """Rows of one month and horizon for every model that looks back on them, and for the model that they are asked of."""
    slot, known, months, own = rows["slot"].to_numpy(), rows["direction"].notna().to_numpy(), plans["month"].to_numpy(), (plans["month"] == plans["block"]).to_numpy()
    x, taken, part, of, bins = None, [], [], [], []
    for k, m in enumerate(plans.itertuples(index=False)):
        inside = known & (slot >= m.cutoff - m.steps) & (slot < m.cutoff - m.forward)
        fit = inside & ((m.fit_before != m.fit_before) | (slot < m.fit_before))
        for kind, chosen in (("fit", fit), ("held", inside & ~fit & (slot >= m.held_slot)), ("score", np.full(len(rows), own[k]))):
            if len(at := np.flatnonzero(chosen)):
                x = np.stack(rows["x"].to_numpy()).astype(float) if x is None else x
                bins += boosting.told(boosting.binned(x[at], [np.asarray(e, float) for e in m.edges], np.asarray(m.middle, float)))
                taken.append(at)
                part += [kind] * len(at)
                of.append(np.full(len(at), k))
    out = rows.iloc[np.concatenate(taken) if taken else []][["horizon", "symbol", "open_time", "direction", "depth_bin"]].reset_index(drop=True)
    out = out.assign(month=months[np.concatenate(of)] if of else months[:0], part=pd.Series(part, dtype=object), bins=pd.Series(bins, dtype=object))
    return out[["month", "horizon", "part", "symbol", "open_time", "direction", "depth_bin", "bins"]]


def sliced(pool: DataFrame, plan: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """Binned rows of every model: month, horizon, part (fit, held, score), symbol, open_time, direction, depth_bin, bins.

    A row's columns are read once, beside the models of its month; what is dealt to the models is a byte a column. Rows of months that no
    model of the plan has are left out first. Without split nothing is held out.
    """
    plan = settled(plan)  # one row a month and horizon
    asked = _spans(plan).select("horizon", F.explode(_blocks()).alias("block")).distinct()
    rows = pool.withColumn("block", month_of(c("slot"))).join(F.broadcast(asked), ["horizon", "block"], "left_semi")
    made = models(rows.drop("block"), plan)
    made = made.join(split.select(*WINDOW, "fit_before", "held_slot"), WINDOW, "left") if split is not None else made.withColumns({x: F.lit(None).cast("long") for x in ("fit_before", "held_slot")})
    numbers = [c(x).cast("double").alias(x) for x in ("fit_before", "held_slot")]
    made = made.select("month", "horizon", F.explode(_blocks()).alias("block"), "cutoff", "forward", "steps", *numbers, "edges", "middle")
    most, groups = rows.groupBy("horizon", "block").count().agg(F.max("count"), F.count(F.lit(1))).first()  # two numbers
    salts = -(-(most or 0) // BINNED_ROWS) or 1
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("symbol", "open_time"), F.lit(salts))).select("horizon", "block", "salt", "symbol", "open_time", "slot", "direction", "depth_bin", "x")
    made = made.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", c("salt").cast("long"))
    place = ["horizon", "block", "salt"]
    schema = "month timestamp, horizon string, part string, symbol string, open_time timestamp, direction string, depth_bin int, bins binary"
    return settled(dealt(rows, *place, groups=groups * salts).groupBy(*place).cogroup(made.groupBy(*place)).applyInPandas(lambda a, b: _binning(a, b), schema))


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the models that one task can hold, dealt by model, and of the larger ones."""
    sizes = settled(rows.groupBy(*WINDOW).count())
    large = sizes.where(c("count") > boosting.TASK_ROWS).select(*WINDOW)
    return dealt(rows.join(large, WINDOW, "left_anti"), *WINDOW, groups=sizes.count()), rows.join(large, WINDOW, "left_semi")


def _frame(pdf: pd.DataFrame, part: str, value=None, name=None) -> pd.DataFrame:
    return pd.DataFrame({"month": pdf["month"], "horizon": pdf["horizon"], "part": part, "symbol": pdf["symbol"], "open_time": pdf["open_time"], "name": name, "value": value, "is_long": (pdf["direction"] == "long").where(pdf["direction"].notna(), None)})


def _fitting(trees: int, depth: int, rate: float, names: list[str]):
    """Fits one (month, horizon): rows of part `held` (probability and outcome), `score` (probability), `gain` (by column) or `failed`."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        use, asked = pdf[pdf["part"] == "fit"], pdf[pdf["part"] == "score"]
        if len(use) < LEAST_ROWS or use["direction"].nunique() < 2:
            return _frame(asked.iloc[:0], "score")
        try:
            y = (use["direction"] == "long").to_numpy(np.int64)
            forest = boosting.grown(boosting.stacked(use["bins"]), y, np.bincount(y, minlength=2), trees, depth, rate)
            out = [_frame(rows, part, boosting.probabilities(boosting.scored(boosting.stacked(rows["bins"]), forest))[:, 0]) for part in ("held", "score") if len(rows := pdf[pdf["part"] == part])]
            first = pd.concat([pdf.iloc[:1]] * len(names))
            return pd.concat([*out, _frame(first, "gain", forest["gain"] / max(forest["gain"].sum(), 1e-12), names).assign(is_long=None)])
        except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:  # what a window's numbers can cause; the run goes on
            return _frame(pdf.iloc[:1], "failed", None, f"{type(e).__name__}: {e}")

    return fit


def _model(*parts: str) -> Column:
    return F.concat_ws("|", c("month").cast("string"), *[c(x) for x in parts])


def fitted(pool: DataFrame, names: list[str], plan: DataFrame, size: tuple[int, int, float] = ML) -> DataFrame:
    """All months' models at work: rows of `_fitting`. Models over boosting.TASK_ROWS rows are grown level by level over all tasks."""
    rows = sliced(pool, plan, settled(holdouts(days(pool, plan))))
    small, large = _by_size(rows)
    done = small.groupBy(*WINDOW).applyInPandas(_fitting(*size, names), _OUT)
    large = large.withColumn("model", _model("horizon"))
    use = large.where("part = 'fit'").select("model", "symbol", "open_time", (c("direction") == "long").cast("int").alias("y"), "bins")
    able = use.groupBy("model").agg(F.count_distinct("y").alias("kinds"), F.count(F.lit(1)).alias("n")).where((c("kinds") == 2) & (c("n") >= LEAST_ROWS)).select("model")
    forests = boosting.grown_over(use.join(able, "model", "left_semi"), *size, single=True)
    if not forests:
        return settled(done)
    spark = pool.sparkSession
    state = spark.sparkContext.broadcast(forests)  # models, not rows

    def asked(batches):
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                if model in state.value:
                    value = boosting.probabilities(boosting.scored(boosting.stacked(part["bins"]), state.value[model]))[:, 0]
                    yield pd.concat([_frame(part[part["part"] == p], p, value[(part["part"] == p).to_numpy()]) for p in ("held", "score")])

    gains = [(m, n, float(g / max(f["gain"].sum(), 1e-12))) for m, f in forests.items() for n, g in zip(names, f["gain"], strict=True)]
    gain = spark.createDataFrame(gains, "model string, name string, value double").join(large.groupBy("model", *WINDOW).agg(F.min_by("symbol", "open_time").alias("symbol"), F.min("open_time").alias("open_time")), "model")
    gain = gain.select(*WINDOW, F.lit("gain").alias("part"), "symbol", "open_time", "name", "value", F.lit(None).cast("boolean").alias("is_long"))
    return settled(done.unionByName(large.where("part <> 'fit'").mapInPandas(asked, _OUT)).unionByName(gain))


def walk_forward(pool: DataFrame, names: list[str], plan: DataFrame, size: tuple[int, int, float] = ML) -> DataFrame:
    """The run's forecasts: every bar of the planned months at every horizon, calibrated, with the raw probability beside; untrained rows say so.

    symbol, horizon, open_time, month, trained, p_long, p_short, raw_long, temperature, source, calibrated_on.
    """
    made = fitted(pool, names, plan, size)
    fits = fit_temperature(made.where("part = 'held'").select(*WINDOW, c("value").alias("p_long"), "is_long"), WINDOW)
    trained = made.where("part = 'score'").select(*WINDOW, "symbol", "open_time", c("value").alias("p_long"), (1 - c("value")).alias("p_short"))
    months = trained.select(*WINDOW).distinct().join(fits, WINDOW, "left").fillna({"temperature": 1.0, "fitted_on": 0})
    out = calibrate(trained, temperature_memory(months, ["horizon"], "month"), WINDOW)
    every = pool.withColumn("month", F.date_trunc("month", "open_time")).join(plan.select(*WINDOW), WINDOW).select("symbol", "horizon", "open_time", "month")
    met = every.join(out.drop("month"), ["symbol", "horizon", "open_time"], "left").withColumn("trained", c("raw_long").isNotNull())
    half = lambda x: F.coalesce(c(x), F.lit(0.5)).alias(x)
    return met.select("symbol", "horizon", "open_time", "month", "trained", half("p_long"), half("p_short"), "raw_long", "temperature", "source", c("fitted_on").alias("calibrated_on"))


#: Forecasters by name: functions of (pool, names, plan) to a run's forecasts.
FORECASTERS: dict[str, Callable[[DataFrame, list[str], DataFrame], DataFrame]] = {
    "ml": walk_forward, "boosted": lambda pool, names, plan: walk_forward(pool, names, plan, BOOSTED),
}
FORECAST = ("symbol", "horizon", "open_time", "month", "trained", "p_long", "p_short")


def register(name: str, forecaster: Callable[[DataFrame, list[str], DataFrame], DataFrame]) -> None:
    """Adds a forecaster under a name of its own; it sees a pool and a plan, and keeps to labels before each month's cutoff itself."""
    if name in FORECASTERS:
        raise ValueError(f"there is a forecaster named {name}")
    FORECASTERS[name] = forecaster


def forecast(name: str, pool: DataFrame, names: list[str], plan: DataFrame) -> DataFrame:
    """A named forecaster's run over the planned months, with `model`; refused where its rows lack a column of FORECAST."""
    if name not in FORECASTERS:
        raise ValueError(f"no forecaster {name}; known are {', '.join(sorted(FORECASTERS))}")
    out = FORECASTERS[name](pool, names, plan)
    if lacking := [x for x in FORECAST if x not in out.columns]:
        raise ValueError(f"forecasts of {name} lack {', '.join(lacking)}")
    return out.withColumn("model", F.lit(name))


def feature_importances(made: DataFrame) -> DataFrame:
    """horizon, name, importance of the last month's models."""
    last = made.where("part = 'gain'").groupBy("horizon").agg(F.max("month").alias("month"))
    return made.where("part = 'gain'").join(last, WINDOW).select("horizon", "name", c("value").alias("importance"))


_DEPTHS = "month timestamp, horizon string, symbol string, open_time timestamp, side string, modelled boolean, bins array<double>"


def _shares(b: np.ndarray, forest: dict | None, counts: dict[int, int], kinds: int) -> np.ndarray:
    """Probabilities of the depth bins of rows: by the model, else the shares of the window, even ones where the side never occurred."""
    p = np.zeros((len(b), kinds))
    present = sorted(counts)
    if forest is not None:
        got = boosting.probabilities(boosting.scored(b, forest))
        p[:, present] = np.concatenate([1 - got, got], axis=1) if len(present) == 2 else got
    else:
        p[:, present or slice(None)] = [counts[k] / sum(counts.values()) for k in present] or 1 / kinds
    return p


def _depth_rows(asked: pd.DataFrame, side: str, modelled: bool, p: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"month": asked["month"], "horizon": asked["horizon"], "symbol": asked["symbol"], "open_time": asked["open_time"], "side": side, "modelled": modelled, "bins": list(p)})


def _depths(kinds: int, size: tuple[int, int, float]):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        known, asked = pdf[(pdf["part"] == "fit") & pdf["depth_bin"].notna()], pdf[pdf["part"] == "score"]
        out = [_depth_rows(asked.iloc[:0], "", False, np.zeros((0, kinds)))]
        b = boosting.stacked(asked["bins"])
        for side in ("long", "short") if len(asked) else ():
            rows = known[known["direction"] == side]
            present, y = np.unique(rows["depth_bin"].to_numpy(np.int64), return_inverse=True)
            counts = np.bincount(y.ravel(), minlength=len(present))
            modelled = len(rows) > 5 and len(present) > 1
            forest = boosting.grown(boosting.stacked(rows["bins"]), y.ravel(), counts, *size) if modelled else None
            out.append(_depth_rows(asked, side, modelled, _shares(b, forest, dict(zip(present.tolist(), counts.tolist(), strict=True)), kinds)))
        return pd.concat(out)

    return fit


def depth_model(pool: DataFrame, plan: DataFrame, size: tuple[int, int, float] = DEPTHS) -> DataFrame:
    """Depth-bin probabilities of each side for every bar of the planned months; the window's shares where a side has too little to learn.

    One model a side has a leaf value for every bin that occurs there.
    """
    kinds = len(d.DEPTH_BINS)
    small, large = _by_size(sliced(pool, plan))
    done = small.groupBy(*WINDOW).applyInPandas(_depths(kinds, size), _DEPTHS)
    use = large.where("part = 'fit' AND depth_bin IS NOT NULL").select(_model("horizon", "direction").alias("model"), "symbol", "open_time", c("depth_bin").alias("y"), "bins")
    counts: dict[str, dict[int, int]] = {}
    for r in use.groupBy("model", "y").count().collect():  # one row a model and bin
        counts.setdefault(r["model"], {})[r["y"]] = r["count"]
    if not counts:
        return done
    able = [m for m, n in counts.items() if len(n) > 1 and sum(n.values()) > 5]
    state = pool.sparkSession.sparkContext.broadcast((boosting.grown_over(use.where(c("model").isin(able)), *size, single=False), counts))  # models, not rows

    def asked(batches):
        forests, counts = state.value
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                b = boosting.stacked(part["bins"])
                for side in ("long", "short"):
                    forest = forests.get(f"{model}|{side}")
                    yield _depth_rows(part, side, forest is not None, _shares(b, forest, counts.get(f"{model}|{side}", {}), kinds))

    return done.unionByName(large.where("part = 'score'").withColumn("model", _model("horizon")).mapInPandas(asked, _DEPTHS))


def window_failures(made: DataFrame, plan: DataFrame, split: DataFrame, run: str = "run") -> DataFrame:
    """One row: months of a run that have no model, by horizon and by what stopped them: too few rows, one direction, or a fit that failed."""
    log = made.where("part = 'failed'").select(*WINDOW, F.lit("fit").alias("stage"), c("name").alias("error"))
    short = plan.join(split, WINDOW, "left").where(F.coalesce("total", F.lit(0)) < LEAST_ROWS).select(*WINDOW, F.lit("slice").alias("stage"), F.concat(F.lit("labelled rows: "), F.coalesce("total", F.lit(0)).cast("string")).alias("error"))
    modelled = made.where("part = 'gain'").select(*WINDOW).distinct()
    single = plan.join(split.where(c("total") >= LEAST_ROWS), WINDOW).join(modelled, WINDOW, "left_anti").join(log, WINDOW, "left_anti").select(*WINDOW, F.lit("slice").alias("stage"), F.lit("one direction").alias("error"))
    rows = log.unionByName(short).unionByName(single)
    return study.failures(rows.select(F.lit(run).alias("run"), "stage", "horizon", c("month").cast("string").alias("window"), "error"))


def run_summary(forecasts: DataFrame, plan: DataFrame, split: DataFrame, labels: DataFrame, correlation: DataFrame) -> DataFrame:
    """One row a horizon: window, power, trained and untrained rows, the last slice's rows, and what the pool is worth."""
    counts = forecasts.groupBy("horizon").agg(F.count_if("trained").alias("trained"), F.count_if(~c("trained")).alias("untrained"), F.count_if(c("source") == "fitted").alias("own_temperature"))
    width = plan.groupBy("horizon", "forward").agg(F.max("steps").alias("window_bars"), F.max("month").alias("month"), F.count(F.lit(1)).alias("refits"))
    last = split.select(*WINDOW, c("total").alias("last_slice"))
    scored = labels.groupBy("horizon").agg(F.count("target_time").alias("scored"))
    out = width.join(counts, "horizon").join(last, WINDOW, "left").join(scored, "horizon").join(correlation.select("horizon", "correlation", "symbols"), "horizon")
    worth = d.effective_symbols(c("symbols").cast("double"), c("correlation"))
    power = d.effective_samples(c("window_bars") - c("forward"), c("forward")) * F.greatest(F.lit(1.0), worth)
    return out.select("horizon", "window_bars", "forward", "refits", "trained", "untrained", "own_temperature", F.coalesce("last_slice", F.lit(0)).alias("last_slice"), power.alias("train_observations"), d.effective_samples(c("scored"), c("forward")).alias("scored_observations"), "correlation", worth.alias("effective_symbols"))
