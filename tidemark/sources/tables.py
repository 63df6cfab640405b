"""Bars and ticks from the trade and event tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one, or on a local master, where none is named, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-files-")
    return f"{base}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once, into a Parquet table in the shared folder, for plans that look at it several times."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utc(c: str | Column) -> Column:
    """A zone-less time as an instant of the session's zone, UTC."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def _told(order: list[str]) -> Column:
    """A trade's place in the whole order with its price, nulls last, as in SQL; null without a price, so that it is neither first nor last."""
    return F.when(F.col("price").isNotNull(), F.struct(*[F.struct(F.col(x).isNull().alias("none"), F.col(x).alias("x")) for x in order], "price", "qty"))


def _sums() -> list[Column]:
    """What is left of trades but for the first and the last: numbers alone."""
    return [
        F.max("price").alias("high"), F.min("price").alias("low"),
        F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("quote_asset_volume"), F.count(F.lit(1)).alias("num_trades"),
        F.sum(F.when(F.col("taker_buy"), F.col("qty")).otherwise(F.lit(0.0))).alias("taker_buy_base_volume"),
    ]


def _opens(order: list[str]) -> list[Column]:
    return [F.min(_told(order)).getField("price").alias("open"), F.max(_told(order)).getField("price").alias("close")]


BAR = ("open", "high", "low", "close", "volume", "quote_asset_volume", "num_trades", "taker_buy_base_volume")


def _rolled(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Open, high, low, close and sums of trades by keys; first and last by the whole order.

    A minimum of structs makes Spark sort all trades before it adds any up. So numbers are added up first, by hash, with the ends of the
    order's first column; only trades at these ends, which a second reading finds, are compared by the whole order.
    """
    first, known = F.col(order[0]), F.col("price").isNotNull()
    made = settled(trades.groupBy(*keys).agg(*_sums(), F.min(F.when(known, first)).alias("lo"), F.max(F.when(known, first)).alias("hi"), F.max(known & first.isNull()).alias("none")))
    made = made.withColumn("hi", F.when(~F.col("none"), F.col("hi"))).drop("none")

    def beside(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
        return a.join(b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how).drop(*[f"__{k}" for k in keys])

    ends = beside(trades.where(known), made.select(*keys, "lo", "hi"), "inner").where(first.eqNullSafe(F.col("lo")) | first.eqNullSafe(F.col("hi")))
    return beside(made, ends.groupBy(*keys).agg(*_opens(order)), "left").select(*keys, *BAR)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the line items: a symbol is a return flag, a trade's price its extended price per unit.

    They are rolled up once, into a table: plans look at bars many times, and each look would read all line items again.
    """
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("open_time"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"),
        (F.col("l_linestatus") == "F").alias("taker_buy"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )
    bars = _rolled(rows, ["symbol", "open_time"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return settled(bars.withColumns({"open_time": utc("open_time"), "interval": F.lit("1d")}))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as trades: a symbol is an event type, the price the value, the size the field k."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), utc("ts").alias("open_time"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"),
        (F.col("user_id") % 2 == 0).alias("taker_buy"), "event_id",
    )


def tick_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    rows = ticks(spark, sf_dir).withColumn("at", F.col("open_time")).withColumn("open_time", F.date_trunc(unit, "open_time"))
    rows = rows.groupBy("symbol", "open_time").agg(*_opens(["at", "event_id"]), *_sums()).select("symbol", "open_time", *BAR)
    return rows.withColumn("interval", F.lit({"hour": "1h", "minute": "1m"}[unit]))


#: The same bars for DuckDB: relations bars, ticks, hours, minutes.
BARS = """
t AS (SELECT l_returnflag AS symbol, l_shipdate AS open_time, l_extendedprice / l_quantity AS price, l_quantity AS qty, l_linestatus = 'F' AS taker_buy,
        (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem WHERE l_quantity > 0),
bars AS (SELECT symbol, open_time, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume,
        sum(price * qty) AS quote_asset_volume, count(*) AS num_trades, sum(CASE WHEN taker_buy THEN qty ELSE 0 END) AS taker_buy_base_volume, '1d' AS interval
        FROM t GROUP BY symbol, open_time)"""
TICKS = """
ticks AS (SELECT event_type AS symbol, ts AS open_time, value AS price, json_extract_string(props, '$.k')::double AS qty, user_id % 2 = 0 AS taker_buy, event_id FROM events)"""


def tick_sql(unit: str, name: str) -> str:
    return f"""
{name} AS (SELECT symbol, date_trunc('{unit}', open_time) AS open_time, arg_min(price, (open_time, event_id)) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, (open_time, event_id)) AS close, sum(qty) AS volume, sum(price * qty) AS quote_asset_volume, count(*) AS num_trades,
        sum(CASE WHEN taker_buy THEN qty ELSE 0 END) AS taker_buy_base_volume, '{ {"hour": "1h", "minute": "1m"}[unit]}' AS interval FROM ticks GROUP BY symbol, date_trunc('{unit}', open_time))"""
