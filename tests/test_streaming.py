"""Rollups on a stream: the batch's rows, late bars, repeated batches."""

from pyspark.sql import functions as F

from tidemark.operators import rollups
from tidemark.streaming import rollup

SCHEMA = "symbol string, interval string, open_time timestamp, open double, high double, low double, close double, volume double"


def bars(spark, hours):
    rows = spark.createDataFrame([("s", "1h", h * 3600, 1.0 + h, 2.0 + h, 0.5 + h, 1.5 + h, 1.0) for h in hours], SCHEMA.replace("open_time timestamp", "at long"))
    return rows.select("symbol", "interval", F.timestamp_seconds("at").alias("open_time"), "open", "high", "low", "close", "volume")


def run(spark, tmp_path, parts, late, interval="1d"):
    """Each part arrives as a run of its own, from where the last one stopped."""
    source = tmp_path / "in"
    for part in parts:
        bars(spark, part).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(bars(spark, part).schema).parquet(str(source))
        rollup.start(stream, interval, str(tmp_path / "out"), str(tmp_path / "state"), late, availableNow=True).awaitTermination()
    return {r["open_time"].timestamp() / 3600: (r["n_source_bars"], r["open"], r["high"], r["low"], r["close"]) for r in rollup.read(spark, str(tmp_path / "out"), interval).collect()}


def as_batch(spark, hours, interval="1d"):
    return {r["open_time"].timestamp() / 3600: (r["n_source_bars"], r["open"], r["high"], r["low"], r["close"]) for r in rollups.rollup(bars(spark, hours), interval).collect()}


def test_micro_batches_give_the_batch_rollup(spark, tmp_path):
    parts = [range(0, 30), range(40, 75), [*range(30, 40), *range(75, 80)]]
    assert run(spark, tmp_path, parts, "10 days") == as_batch(spark, range(80))


def test_weeks_begin_on_monday(spark, tmp_path):
    assert run(spark, tmp_path, [range(0, 400, 7)], "10 days", "1w") == as_batch(spark, range(0, 400, 7), "1w")


def test_bars_behind_the_watermark_are_left_out(spark, tmp_path):
    got = run(spark, tmp_path, [range(0, 20), range(200, 220), [20, 221]], "1 day")
    want = as_batch(spark, [*range(0, 20), *range(200, 220), 221])
    assert got == want and got[0][0] == 20


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    rows = rollups.rollup(bars(spark, range(30)), "1d").withColumnRenamed("open_time", "bucket").drop("interval")
    write = rollup._sink(str(tmp_path / "out"))
    write(rows, 0)
    write(rows, 0)
    write(rows.where("n_source_bars < 24").withColumn("n_source_bars", F.lit(7).cast("long")), 1)
    got = {r["open_time"].timestamp(): r["n_source_bars"] for r in rollup.read(spark, str(tmp_path / "out"), "1d").collect()}
    assert got == {0.0: 24, 86400.0: 7}
