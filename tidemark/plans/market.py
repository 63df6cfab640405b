"""Registered queries over bars: sources, rollups, quality, features and joins, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import domain as d
from ..operators import features, forecasts, quality, rollups, series
from ..sources import tables
from ..sources.tables import BARS, TICKS, daily_bars, scratch, tick_bars, tick_sql

c = F.col
SHIFT = 3.7e-9
DIGITS = {"atr_14": 3, "macd_hist": 3}  # long recursions over large prices
FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, so that the order of a sum does not show. A shift keeps decimal halves off the edge; no negative zero."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.DoubleType):
            out.append((F.round(c(f.name) + SHIFT, DIGITS.get(f.name, 6)) + 0.0).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            out.append(F.transform(f.name, lambda x: F.round(x + SHIFT, 6) + 0.0).alias(f.name))
        else:
            out.append(c(f.name))
    return df.select(*out)


def select(ctes: str, source: str, plain: str = "", doubles: str = "") -> str:
    """SQL: columns as they are and columns to 6 places. `a AS b` renames."""
    cols = [x.strip() for x in plain.split(",") if x.strip()]
    for x in (x.strip() for x in doubles.split(",") if x.strip()):
        expr, _, name = x.rpartition(" AS ")
        cols.append(f"round(({expr or x})::double + {SHIFT}, {DIGITS.get(name, 6)}) + 0.0 AS {name}")
    return f"WITH {ctes.strip().rstrip(',')} SELECT {', '.join(cols)} FROM {source}"


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = (lambda spark, sf_dir: rounded(f(spark, sf_dir)), sql)
        return f

    return add


OHLC = "open, high, low, close, volume"
HOURS = f"{TICKS}, {tick_sql('hour', 'hours')}"
MINUTES = f"{TICKS}, {tick_sql('minute', 'minutes')}"
W = "(PARTITION BY symbol ORDER BY open_time)"


def wr(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {wr(n)} = {n} THEN {agg}({x}) OVER {wr(n)} END"


def ewm(x: str, span: int) -> str:
    a = 2 / (span + 1)
    return f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 511 PRECEDING AND CURRENT ROW), lambda a, v: a * {1 - a!r} + v * {a!r})"


# ---- rollups and sources


@query(select(BARS, "bars", "symbol, open_time, num_trades", f"{OHLC}, quote_asset_volume, taker_buy_base_volume"))
def to_bars(spark, sf_dir):
    return daily_bars(spark, sf_dir).drop("interval")


@query(select(HOURS, "hours", "symbol, open_time, num_trades", OHLC))
def tick_hours(spark, sf_dir):
    return tick_bars(spark, sf_dir, "hour").select("symbol", "open_time", "num_trades", *OHLC.split(", "))


def rollup_sql(source: str, bucket: str) -> str:
    return f"""roll AS (SELECT symbol, {bucket} AS open_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume,
      sum(num_trades)::bigint AS num_trades, count(*) AS n_source_bars FROM {source} GROUP BY 1, 2)"""


@query(select(BARS + ", " + rollup_sql("bars", "date_trunc('week', open_time)"), "roll", "symbol, open_time, num_trades, n_source_bars", OHLC))
def rollup_bars(spark, sf_dir):
    out = rollups.rollup(daily_bars(spark, sf_dir), "1w")
    return out.select("symbol", "open_time", "num_trades", "n_source_bars", *OHLC.split(", "))


MANY = [("4h", "time_bucket(interval '4 hours', open_time, timestamp '1970-01-01')"), ("1d", "date_trunc('day', open_time)"), ("3d", "time_bucket(interval '3 days', open_time, timestamp '1970-01-01')"), ("1w", "date_trunc('week', open_time)")]


@query(
    f"WITH {HOURS}, u AS ("
    + " UNION ALL ".join(f"SELECT '{i}' AS interval, symbol, {b} AS open_time, arg_min(open, h.open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, h.open_time) AS close, sum(volume) AS volume, count(*) AS n_source_bars FROM hours h GROUP BY 1, 2, 3" for i, b in MANY)
    + f") SELECT interval, symbol, open_time, n_source_bars, round(open + {SHIFT}, 6) + 0.0 AS open, round(high + {SHIFT}, 6) + 0.0 AS high, round(low + {SHIFT}, 6) + 0.0 AS low, round(close + {SHIFT}, 6) + 0.0 AS close, round(volume + {SHIFT}, 6) + 0.0 AS volume FROM u"
)
def rollup_many(spark, sf_dir):
    out = rollups.rollup_many(tick_bars(spark, sf_dir, "hour"), [i for i, _ in MANY])
    return out.select("interval", "symbol", "open_time", "n_source_bars", *OHLC.split(", "))


@query(
    f"WITH {HOURS}, u AS (" + " UNION ALL ".join(f"SELECT '{i}' AS interval, symbol, count(DISTINCT {b}) AS bars, NULL AS error FROM hours GROUP BY 2" for i, b in MANY if i != "3d")
    + ") SELECT * FROM u UNION ALL SELECT x, symbol, 0, CASE x WHEN '5m' THEN 'finer than the source' ELSE 'unsupported interval' END FROM (SELECT DISTINCT symbol FROM hours) CROSS JOIN (VALUES ('5m'), ('7x')) v(x)"
)
def rollup_report(spark, sf_dir):
    """Intervals asked for in one text, one unknown and one too fine: what was made of each, and what was not."""
    return rollups.rollup_each(tick_bars(spark, sf_dir, "hour"), "4h, 1d 7x,1w 5m 4h")[1]


@query(select(BARS, "bars WHERE open_time BETWEEN timestamp '1997-03-01' AND timestamp '1998-02-28 23:59:59.999'", "symbol, open_time", OHLC))
def time_range(spark, sf_dir):
    return features.time_range(daily_bars(spark, sf_dir), "1997-03", "1998-02").select("symbol", "open_time", *OHLC.split(", "))


@query(select(BARS, "bars WHERE symbol = 'A' AND close >= 1000 AND close <= 1500", "symbol, open_time", OHLC))
def scan_bars(spark, sf_dir):
    rows = rollups.scan(daily_bars(spark, sf_dir), [("symbol", "==", "A"), ("close", ">=", 1000), ("close", "<=", 1500)])
    return rows.select("symbol", "open_time", *OHLC.split(", "))


@query("SELECT to_timestamp(o_orderkey::bigint + 1000000000)::timestamp AS open_time, count(*) AS n FROM orders GROUP BY 1")
def normalize_time(spark, sf_dir):
    """Order keys read as epoch times, half in milliseconds and half in microseconds."""
    rows = tables.table(spark, sf_dir, "orders").withColumn("epoch", (c("o_orderkey") + 1_000_000_000) * F.when(c("o_orderkey") % 2 == 0, 1000).otherwise(1_000_000))
    return rows.select(rollups.normalize_time(c("epoch")).cast("timestamp_ntz").alias("open_time")).groupBy("open_time").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BARS}, a AS (SELECT symbol, open_time, close, num_trades FROM bars WHERE symbol <> 'N' UNION ALL SELECT symbol, open_time, close, NULL FROM bars WHERE symbol = 'N')
SELECT symbol, open_time, round(close + {SHIFT}, 6) + 0.0 AS close, num_trades FROM a""")
def union_versions(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).select("symbol", "open_time", "close", "num_trades")
    return rollups.union_versions([bars.where("symbol <> 'N'"), bars.where("symbol = 'N'").drop("num_trades")])


@query(select(BARS, "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM bars) WHERE k <= 50", "symbol, open_time", OHLC))
def latest_bars(spark, sf_dir):
    return rollups.latest(daily_bars(spark, sf_dir), 50).select("symbol", "open_time", *OHLC.split(", "))


@query(f"WITH {BARS} SELECT symbol, min(open_time) AS first, max(open_time) AS last, count(*) AS bars, round(date_diff('day', min(open_time), max(open_time)) / 365.25 + {SHIFT}, 6) + 0.0 AS years FROM bars GROUP BY symbol")
def dataset_extent(spark, sf_dir):
    out = daily_bars(spark, sf_dir).groupBy("symbol").agg(F.min("open_time").alias("first"), F.max("open_time").alias("last"), F.count(F.lit(1)).alias("bars"))
    return out.withColumn("years", F.date_diff("last", "first") / 365.25)


@query("""WITH s AS (SELECT DISTINCT event_type || k AS symbol FROM events CROSS JOIN (VALUES ('USDT'), ('BTC'), ('FDUSD')) t(k))
SELECT symbol, regexp_extract(symbol, '^(.+)(FDUSD|USDT|BTC)$', 1) AS base, regexp_extract(symbol, '^(.+)(FDUSD|USDT|BTC)$', 2) AS quote FROM s""")
def symbol_parts(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select("event_type").distinct()
    symbols = events.withColumn("k", F.explode(F.array(*map(F.lit, ("USDT", "BTC", "FDUSD"))))).select(F.concat("event_type", "k").alias("symbol"))
    return rollups.symbol_parts(symbols, ["USDT", "FDUSD", "BTC"])


@query("SELECT event_type AS symbol FROM events UNION SELECT l_returnflag FROM lineitem")
def distinct_symbols(spark, sf_dir):
    return tables.ticks(spark, sf_dir).select("symbol").union(tables.table(spark, sf_dir, "lineitem").select("l_returnflag")).distinct()


@query(f"WITH {BARS} SELECT open_time FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)")
def common_dates(spark, sf_dir):
    return rollups.common_dates(daily_bars(spark, sf_dir))


@query(f"WITH {BARS} SELECT count(*) AS rows, min(open_time) AS first, max(open_time) AS last, count(DISTINCT symbol) AS symbols FROM bars")
def profile_table(spark, sf_dir):
    return daily_bars(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.min("open_time").alias("first"), F.max("open_time").alias("last"), F.count_distinct("symbol").alias("symbols"))


@query(f"""WITH {HOURS}, months AS (SELECT DISTINCT symbol, date_trunc('day', open_time) AS day FROM hours), base AS (SELECT DISTINCT symbol, date_trunc('day', open_time) AS day FROM ticks),
want AS (SELECT symbol, unnest(generate_series((SELECT min(day) FROM base), (SELECT max(day) FROM base) + interval 3 day, interval 1 day)) AS day FROM (SELECT DISTINCT symbol FROM base))
SELECT symbol, day FROM want ANTI JOIN months USING (symbol, day)""")
def missing_partitions(spark, sf_dir):
    hours = tick_bars(spark, sf_dir, "hour").select("symbol", F.date_trunc("day", "open_time").alias("day")).distinct()
    ticks = tables.ticks(spark, sf_dir)
    span = ticks.agg(F.date_trunc("day", F.min("open_time")).alias("a"), F.date_trunc("day", F.max("open_time")).alias("b"))
    want = ticks.select("symbol").distinct().crossJoin(F.broadcast(span)).select("symbol", F.explode(F.expr("sequence(a, b + interval 3 day, interval 1 day)")).alias("day"))
    return want.join(hours, ["symbol", "day"], "left_anti")


# ---- quality

BAD = """b AS (SELECT symbol, open_time, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS k FROM hours),
bad AS (SELECT symbol, open_time, open, CASE WHEN k % 97 = 0 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN k % 131 = 0 THEN -volume ELSE volume END AS volume FROM b
  UNION ALL SELECT symbol, open_time, open, high, low, close, volume FROM b WHERE k % 83 = 0)"""


def bad_hours(spark, sf_dir):
    """Hourly bars with planted faults: highs under lows, negative volumes, repeated times."""
    rows = series.indexed(tick_bars(spark, sf_dir, "hour"), days=4).withColumn("k", c("idx") + 1)
    broken = rows.withColumns({"high": F.when(c("k") % 97 == 0, c("low") - 1).otherwise(c("high")), "volume": F.when(c("k") % 131 == 0, -c("volume")).otherwise(c("volume"))})
    return broken.unionByName(rows.where("k % 83 = 0")).drop("idx", "k")


@query(f"WITH {HOURS}, {BAD} SELECT symbol, open_time, count(*) AS copies FROM bad GROUP BY 1, 2 HAVING count(*) > 1")
def qa_duplicates(spark, sf_dir):
    return quality.duplicates(bad_hours(spark, sf_dir)).drop("interval")


VIOLATIONS = """v AS (SELECT symbol, open_time, 'negative' AS kind FROM bad WHERE least(open, high, low, close, volume) < 0 UNION ALL
SELECT symbol, open_time, 'high_below_body' FROM bad WHERE high < greatest(open, close) UNION ALL SELECT symbol, open_time, 'low_above_body' FROM bad WHERE low > least(open, close))"""


@query(f"WITH {HOURS}, {BAD}, {VIOLATIONS} SELECT symbol, open_time, kind, count(*) AS n FROM v GROUP BY ALL")
def qa_ohlc(spark, sf_dir):
    return quality.ohlc_violations(bad_hours(spark, sf_dir)).groupBy("symbol", "open_time", "kind").agg(F.count(F.lit(1)).alias("n"))


GAPS = f"g AS (SELECT symbol, open_time AS until, lag(open_time) OVER {W} AS since FROM hours)"


@query(f"WITH {HOURS}, {GAPS} SELECT symbol, since, until, epoch(until - since)::bigint AS seconds FROM g WHERE epoch(until - since) > 3600 + 120")
def qa_gaps(spark, sf_dir):
    return quality.gaps(tick_bars(spark, sf_dir, "hour"), 3600 + 120).select("symbol", "since", "until", "seconds")


@query(f"WITH {HOURS}, {GAPS} SELECT symbol, since, until, greatest(1, round_even(epoch(until - since) / 3600, 0)::bigint - 1) AS missing FROM g WHERE epoch(until - since) > 5400")
def gaps_eval(spark, sf_dir):
    return quality.gaps(tick_bars(spark, sf_dir, "hour"), 5400).select("symbol", "since", "until", F.greatest(F.lit(1), F.bround(c("seconds") / 3600, 0).cast("long") - 1).alias("missing"))


@query(f"WITH {HOURS}, {GAPS} SELECT symbol, since + interval 1 hour AS first_missing, until - interval 1 hour AS last_missing, greatest(1, epoch(until - since)::bigint // 3600 - 1) AS missing FROM g WHERE epoch(until - since) > 3600")
def gaps_chart(spark, sf_dir):
    rows = quality.gaps(tick_bars(spark, sf_dir, "hour"), 3600)
    return rows.select("symbol", F.expr("since + interval 1 hour").alias("first_missing"), F.expr("until - interval 1 hour").alias("last_missing"), F.greatest(F.lit(1), F.floor(c("seconds") / 3600) - 1).alias("missing"))


@query(f"WITH {HOURS}, {GAPS}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY until) AS k FROM g WHERE epoch(until - since) > 3600) SELECT symbol, since, until, k FROM p WHERE k <= 20")
def gap_preview(spark, sf_dir):
    return quality.preview(quality.gaps(tick_bars(spark, sf_dir, "hour"), 3600), 20).select("symbol", "since", "until", "k")


REPORT = """dup AS (SELECT symbol, date_trunc('month', open_time) AS month, sum(n) AS duplicates FROM (SELECT symbol, open_time, count(*) AS n FROM bad GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1, 2),
viol AS (SELECT symbol, date_trunc('month', open_time) AS month, count(*) AS violations FROM v GROUP BY 1, 2),
gap AS (SELECT symbol, date_trunc('month', until) AS month, count(*) AS gaps FROM (SELECT symbol, open_time AS until, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS since FROM bad) WHERE epoch(until - since) > 3720 GROUP BY 1, 2),
rep AS (SELECT symbol, month, rows, coalesce(duplicates, 0)::bigint AS duplicates, coalesce(violations, 0)::bigint AS violations, coalesce(gaps, 0)::bigint AS gaps,
  coalesce(duplicates, 0) + coalesce(violations, 0) + coalesce(gaps, 0) = 0 AS passed
  FROM (SELECT symbol, date_trunc('month', open_time) AS month, count(*) AS rows FROM bad GROUP BY 1, 2) LEFT JOIN dup USING (symbol, month) LEFT JOIN viol USING (symbol, month) LEFT JOIN gap USING (symbol, month))"""


def as_written(rows: DataFrame, *order) -> DataFrame:
    """rows written to files in an order, and read back with their places there."""
    folder = scratch(rows.sparkSession)
    names = [f"__o{k}" for k in range(len(order))]
    rows.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(4, *names).sortWithinPartitions(*names).drop(*names).write.parquet(folder)
    return quality.ingested(rows.sparkSession, folder)


@query(f"""WITH {HOURS}, {BAD}, {VIOLATIONS}, {REPORT}, so AS (SELECT symbol, date_trunc('month', open_time) AS month, open_time < lag(open_time) OVER (PARTITION BY symbol ORDER BY day(open_time) = 15, open_time) AS back FROM bad),
sb AS (SELECT symbol, month, count_if(back)::bigint AS out_of_order FROM so GROUP BY 1, 2) SELECT rep.* REPLACE (passed AND out_of_order = 0 AS passed), out_of_order, out_of_order = 0 AS sorted FROM rep JOIN sb USING (symbol, month)""")
def qa_report(spark, sf_dir):
    """Checks of hours of which those of the 15th were written late."""
    rows = bad_hours(spark, sf_dir)
    return quality.report(as_written(rows, F.day("open_time") == 15, c("symbol"), c("open_time")), 3600 + 120).drop("interval")


@query(f"WITH {HOURS}, {BAD}, {VIOLATIONS}, {REPORT} SELECT symbol, sum(rows)::bigint AS rows, sum(duplicates)::bigint AS duplicates, sum(violations)::bigint AS violations, sum(gaps)::bigint AS gaps FROM rep GROUP BY symbol")
def qa_totals(spark, sf_dir):
    rep = quality.report(bad_hours(spark, sf_dir), 3600 + 120)
    return rep.groupBy("symbol").agg(*[F.sum(x).alias(x) for x in ("rows", "duplicates", "violations", "gaps")])


@query(f"WITH {HOURS}, s AS (SELECT symbol, open_time < lag(open_time) OVER (PARTITION BY symbol ORDER BY volume, open_time) AS back FROM hours) SELECT symbol, count_if(back)::bigint AS out_of_order, count_if(back) = 0 AS sorted FROM s GROUP BY symbol")
def qa_sorted(spark, sf_dir):
    """The hours from files that were written in the order of their volume."""
    return quality.sortedness(as_written(tick_bars(spark, sf_dir, "hour"), c("volume"), c("open_time"))).drop("interval")


@query(f"""WITH {BARS}, m AS (SELECT symbol, count(DISTINCT date_trunc('month', open_time)) AS months, count(*) AS bars, min(open_time) AS first, max(open_time) AS last FROM bars GROUP BY symbol),
g AS (SELECT symbol, count(*) AS gaps FROM (SELECT symbol, open_time - lag(open_time) OVER {W} AS d FROM bars) WHERE d > interval 1 day GROUP BY symbol)
SELECT symbol, bars, months, date_diff('month', first, last) + 1 AS expected_months, coalesce(gaps, 0) AS gaps, first, last,
CASE WHEN months < date_diff('month', first, last) + 1 THEN 'incomplete' WHEN coalesce(gaps, 0) > 0 THEN 'warning' ELSE 'complete' END AS status FROM m LEFT JOIN g USING (symbol)""")
def inventory(spark, sf_dir):
    return quality.inventory(daily_bars(spark, sf_dir), 86400).drop("interval")


@query(f"""WITH {BARS}, g AS (SELECT symbol, count(*) AS gaps FROM (SELECT symbol, open_time - lag(open_time) OVER {W} AS d FROM bars) WHERE d > interval 1 day GROUP BY symbol)
SELECT symbol, s AS step, CASE s WHEN 1 THEN 'ingest' WHEN 2 THEN 'rollup' ELSE 'features' END AS action FROM g CROSS JOIN (VALUES (1), (2), (3)) t(s)""")
def repair_plan(spark, sf_dir):
    return quality.repair_plan(quality.inventory(daily_bars(spark, sf_dir), 86400)).drop("interval")


# ---- features

F1 = f"f1 AS (SELECT *, ln(close) - ln(lag(close) OVER {W}) AS r1, close - lag(close) OVER {W} AS ch, lag(close) OVER {W} AS pc FROM bars)"
PARTS = {
    "log_returns": ("", ", ".join(f"ln(close) - ln(lag(close, {n}) OVER {W}) AS log_return_{n}b" for n in (1, 3, 7, 14))),
    "rolling_vol": ("", ", ".join(f"{full('stddev_samp', 'r1', n)} AS rolling_vol_{n}" for n in (7, 14, 30))),
    "drawdowns": ("", f"(high - low) / close AS candle_range, " + ", ".join(f"close / {full('max', 'close', n).replace('CASE', '(CASE').replace('END', 'END)')} - 1 AS rolling_drawdown_{n}" for n in (30, 90))),
    "moving_averages": ("", f"{full('avg', 'close', 10)} AS ma_10, {full('avg', 'close', 30)} AS ma_30"),
    "bollinger": ("", f"{full('avg', 'close', 20)} AS bb_mid, {full('stddev_samp', 'close', 20)} AS sd"),
    "rsi": ("", f"{ewm('CASE WHEN ch > 0 THEN ch ELSE 0.0 END::double', 14)} AS gain, {ewm('CASE WHEN ch < 0 THEN -ch ELSE 0.0 END::double', 14)} AS loss"),
    "atr": ("", f"{ewm('greatest(high - low, abs(high - pc), abs(low - pc))', 14)} AS atr_14"),
    "macd": ("", f"{ewm('close', 12)} - {ewm('close', 26)} AS line"),
    "obv": ("", f"sum(CASE WHEN ch > 0 THEN volume WHEN ch < 0 THEN -volume ELSE 0 END) OVER {W} AS obv, CASE WHEN ch > 0 THEN volume WHEN ch < 0 THEN -volume ELSE 0 END AS signed"),
    "order_flow": ("", f"taker_buy_base_volume / nullif(volume, 0) AS taker_buy_ratio, volume / nullif(num_trades, 0) AS avg_trade_size, num_trades / ({full('avg', 'num_trades', 30)}) AS trade_count_rel_30, volume / ({full('avg', 'volume', 30)}) AS volume_rel_30, {full('avg', 'volume', 30)} AS mean_volume"),
}
F2 = "f2 AS (SELECT *, " + ", ".join(x for _, x in PARTS.values()) + " FROM f1)"
F3 = f"""f3 AS (SELECT *, ma_10 - ma_30 AS ma_diff, ma_10 - lag(ma_10) OVER {W} AS ma_slope, bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower,
 least(greatest(CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END, 0), 100) AS rsi_14, line - {ewm('line', 9)} AS macd_hist,
 2 * taker_buy_ratio - 1 AS flow_imbalance, {full('avg', 'taker_buy_ratio', 14)} AS taker_buy_ratio_14, signed / mean_volume AS obv_change_rel, avg_trade_size / ({full('avg', 'avg_trade_size', 30)}) AS avg_trade_size_rel_30 FROM f2)"""
FEATURES = f"{BARS}, {F1}, {F2}, {F3}"
NAMES = {
    "log_returns": "log_return_1b, log_return_3b, log_return_7b, log_return_14b", "rolling_vol": "rolling_vol_7, rolling_vol_14, rolling_vol_30", "drawdowns": "candle_range, rolling_drawdown_30, rolling_drawdown_90",
    "moving_averages": "ma_10, ma_30, ma_diff, ma_slope", "bollinger": "bb_mid, bb_upper, bb_lower", "rsi": "rsi_14", "atr": "atr_14", "macd": "macd_hist", "obv": "obv",
    "order_flow": "taker_buy_ratio, avg_trade_size, flow_imbalance, taker_buy_ratio_14, trade_count_rel_30", "volume_relative": "volume_rel_30, obv_change_rel, avg_trade_size_rel_30",
}
RELATIVE = ", ".join([f"{x} / close - 1 AS {x}_rel" for x in ("ma_10", "ma_30", "bb_mid", "bb_upper", "bb_lower", "open", "high", "low")] + [f"{x} / close AS {x}_rel" for x in ("ma_diff", "ma_slope", "atr_14", "macd_hist")])


def _feature_query(name: str, columns: str) -> None:
    names = [x.rpartition(" AS ")[2].strip() for x in columns.split(",")]

    def run(spark, sf_dir):
        return features.build(daily_bars(spark, sf_dir)).select("symbol", "open_time", *names)

    run.__name__ = name
    query(select(FEATURES, "f3", "symbol, open_time", columns))(run)


for _name, _columns in NAMES.items():
    _feature_query(_name, _columns)
_feature_query("relative_features", RELATIVE)

INTRADAY = f"""{MINUTES}, x AS (SELECT symbol, open_time::date AS date, close / lag(close) OVER (PARTITION BY symbol, open_time::date ORDER BY open_time) - 1 AS r,
 close / max(close) OVER (PARTITION BY symbol, open_time::date ORDER BY open_time) - 1 AS fall FROM minutes),
intra AS (SELECT symbol, date, coalesce(sum(r * r), 0) AS realized_vol_1d, count_if(abs(r) > 0.02)::bigint AS jump_count, min(fall) AS max_intraday_drawdown FROM x GROUP BY 1, 2)"""


@query(select(INTRADAY, "intra", "symbol, date::varchar AS date, jump_count", "realized_vol_1d, max_intraday_drawdown"))
def intraday_daily(spark, sf_dir):
    return features.intraday_daily(tick_bars(spark, sf_dir, "minute")).withColumn("date", c("date").cast("string"))


DAYS = "dayb AS (SELECT symbol, date_trunc('day', open_time) AS open_time, arg_min(open, open_time) AS open, arg_max(close, open_time) AS close FROM minutes GROUP BY 1, 2)"


@query(select(f"{INTRADAY}, {DAYS}, j AS (SELECT symbol, open_time, close, jump_count, realized_vol_1d FROM dayb LEFT JOIN intra ON intra.symbol = dayb.symbol AND intra.date = dayb.open_time::date)".replace("SELECT symbol, open_time, close, jump", "SELECT dayb.symbol, open_time, close, jump"), "j", "symbol, open_time, jump_count", "close, realized_vol_1d"))
def join_intraday(spark, sf_dir):
    minutes = tick_bars(spark, sf_dir, "minute")
    days = rollups.rollup(minutes, "1d").withColumn("date", F.to_date("open_time"))
    return days.join(features.intraday_daily(minutes), ["symbol", "date"], "left").select("symbol", "open_time", "jump_count", "close", "realized_vol_1d")


ALL = [x.rpartition(" AS ")[2].strip() for k, v in NAMES.items() for x in v.split(",")] + [x.rpartition(" AS ")[2].strip() for x in RELATIVE.split(",")]


@query(select(FEATURES, "f3 WHERE open_time >= timestamp '1997-01-01'", "symbol, open_time", ", ".join(NAMES.values()) + ", " + RELATIVE))
def build_features(spark, sf_dir):
    """Every feature over the full history, then the range."""
    return features.time_range(features.build(daily_bars(spark, sf_dir)), "1997-01-01").select("symbol", "open_time", *ALL)


@query(select(FEATURES, "f3 WHERE isfinite(close) AND isfinite(open)", "symbol, open_time", "close, rsi_14, macd_hist"))
def chart_rows(spark, sf_dir):
    rows = features.build(daily_bars(spark, sf_dir))
    finite = lambda x: F.abs(x) < float("inf")
    return rows.where(finite("open") & finite("high") & finite("low") & finite("close") & finite("volume")).select("symbol", "open_time", *[F.when(finite(x), c(x)).alias(x) for x in ("close", "rsi_14", "macd_hist")])


MANY_SERIES = f"""{HOURS}, u AS ({' UNION ALL '.join(f"SELECT DISTINCT '{i}' AS interval, symbol, {b} AS open_time FROM hours" for i, b in MANY)}), se AS (SELECT symbol, interval, count(*) AS bars FROM u GROUP BY 1, 2),
im AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in d.INTERVALS.items())}) a(interval, m)), hm AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in d.HORIZONS.items())}) b(horizon, k))"""


@query(f"WITH {MANY_SERIES}, st AS (SELECT symbol, interval, horizon, bars, greatest(1, round_even(k * 1440.0 / m, 0))::bigint AS steps FROM se JOIN im USING (interval) CROSS JOIN hm) SELECT symbol, interval, horizon, steps, greatest(0, bars - steps)::bigint AS labelled FROM st")
def interval_steps(spark, sf_dir):
    """Steps of every horizon in every series that the ticks hold, and the bars of it whose label lies inside."""
    bars = rollups.rollup_many(tick_bars(spark, sf_dir, "hour"), [i for i, _ in MANY])
    series_ = bars.groupBy("symbol", "interval").agg(F.count(F.lit(1)).alias("bars"))
    rows = series_.crossJoin(d.horizons(spark)).withColumn("steps", d.interval_steps(c("forward"), c("interval")))
    return rows.select("symbol", "interval", "horizon", "steps", F.greatest(F.lit(0), c("bars") - c("steps")).cast("long").alias("labelled"))


RAW = """rw AS (SELECT event_type AS symbol, '1m' AS interval, epoch_ms(date_trunc('minute', ts)) AS t, value AS price, event_id FROM events)"""


@query(f"WITH {RAW}, fw AS (SELECT symbol, interval, t, arg_min(price, event_id) AS close FROM rw GROUP BY 1, 2, 3) SELECT symbol, make_timestamp(t * 1000) AS open_time, round(close + {SHIFT}, 6) + 0.0 AS close FROM fw")
def first_wins(spark, sf_dir):
    """Ticks as candles of their minute, ingested in the order of their id: of those of one minute the first counts."""
    rows = tables.ticks(spark, sf_dir).withColumns({"interval": F.lit("1m"), "open_time": rollups.normalize_time(F.unix_millis(F.date_trunc("minute", "open_time"))), "close": c("price")})
    return rollups.first_wins(rows, "event_id").select("symbol", "open_time", "close")


@query(f"WITH {BARS}, o AS (SELECT symbol, open_time, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS a, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS z FROM bars) SELECT symbol, open_time, round(close + {SHIFT}, 6) + 0.0 AS close, CASE WHEN a <= 5 THEN 'head' ELSE 'tail' END AS part FROM o WHERE a <= 5 OR z <= 5")
def profile_rows(spark, sf_dir):
    """First and last five bars of each symbol."""
    return rollups.ends(daily_bars(spark, sf_dir), 5).select("symbol", "open_time", "close", "part")


@query("SELECT k AS days, CASE WHEN k = 364 THEN '1 year' WHEN k = 7 THEN '1 week' WHEN k % 7 = 0 THEN (k // 7)::varchar || ' weeks' ELSE k::varchar || ' days' END AS label, count(*) AS orders FROM (SELECT greatest(1, date_diff('day', timestamp '1995-01-01', o_orderdate) % 400) AS k FROM orders) GROUP BY 1, 2")
def horizon_label(spark, sf_dir):
    """Horizons of as many days as orders are old, in words."""
    days = F.greatest(F.lit(1), F.date_diff(c("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 400).cast("long")
    return tables.table(spark, sf_dir, "orders").select(days.alias("days")).groupBy("days").agg(F.count(F.lit(1)).alias("orders")).select("days", d.horizon_label(c("days")).alias("label"), "orders")


@query(f"""WITH v AS (SELECT symbol, day, {", ".join(f"coalesce(sum(CASE WHEN value BETWEEN {a} AND {b} THEN value - 100 END), 0) AS p{k}" for k, (a, b) in enumerate(((0, 120), (120, 240), (240, 500))))} FROM (SELECT event_type AS symbol, ts::date AS day, value FROM events) GROUP BY 1, 2),
w AS (SELECT *, greatest(p0, 0) + greatest(p1, 0) + greatest(p2, 0) AS s FROM v) SELECT symbol, day::varchar AS day, {", ".join(f"round(CASE WHEN s > 1e-12 THEN greatest(p{k}, 0) / s ELSE 1.0 / 3 END + {SHIFT}, 6) + 0.0 AS p{k}" for k in range(3))} FROM w""")
def normalize_probs(spark, sf_dir):
    """Daily sums of values in three ranges, less 100 each, read as weights: negative ones count as 0."""
    part = lambda a, b: F.coalesce(F.sum(F.when(c("price").between(a, b), c("price") - 100)), F.lit(0.0))
    rows = tables.ticks(spark, sf_dir).groupBy("symbol", F.to_date("open_time").cast("string").alias("day")).agg(part(0, 120).alias("a"), part(120, 240).alias("b"), part(240, 500).alias("e"))
    rows = rows.withColumn("p", d.normalized(F.array("a", "b", "e"), 3))
    return rows.select("symbol", "day", *[c("p")[k].alias(f"p{k}") for k in range(3)])


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS open_time FROM events WHERE event_id % 5 <> 4")
def bar_key(spark, sf_dir):
    """Times written in four ISO forms, and some that are none, read as instants."""
    at = c("ts").cast("timestamp")
    iso = lambda pattern: F.date_format(at, pattern)
    kind = c("event_id") % 4
    text = F.when(kind == 0, iso("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, iso("yyyy-MM-dd'T'HH:mm:ss'.000+00:00'")).when(kind == 2, iso("yyyy-MM-dd HH:mm:ss")).otherwise(iso("yyyy-MM-dd"))
    rows = tables.table(spark, sf_dir, "events").select("event_id", d.bar_key(F.when(c("event_id") % 5 == 4, F.lit("no time")).otherwise(text)).alias("open_time"))
    return rows.where("open_time is not null").select("event_id", c("open_time").cast("timestamp_ntz").alias("open_time"))


def queries() -> dict:
    return {k: v[0] for k, v in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in FOUND.items() if v[1]}
