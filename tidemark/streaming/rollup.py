"""Rollups of bars that arrive as a stream.

Each micro-batch hands out the buckets that it changed, as they now stand, and they are written under the batch's number; a batch that is
repeated after a failure replaces what it wrote. Readers take a bucket's newest row. Bars that come later than the watermark allows after the
newest one seen are left out, and their bucket stays as it was; buckets that old are dropped from the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.domain import INTERVALS
from ..operators.rollups import _aggs

c = F.col


def rolled(stream: DataFrame, interval: str, late: str) -> DataFrame:
    """Buckets (symbol, bucket, as `rollups.rollup`) of a stream of bars, kept open for `late`; weeks begin on Monday."""
    shift = "4 days" if interval == "1w" else "0 seconds"  # the epoch was a Thursday
    at = F.window("open_time", f"{INTERVALS[interval]} minutes", startTime=shift).alias("w")
    rows = stream.withWatermark("open_time", late).groupBy("symbol", at).agg(*_aggs(stream.columns))
    return rows.withColumn("bucket", c("w.start")).drop("w")


def _sink(path: str):
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def start(stream: DataFrame, interval: str, path: str, checkpoint: str, late: str = "2 days", **trigger) -> StreamingQuery:
    """Runs the rollup into path; trigger as for `DataStreamWriter.trigger`."""
    return rolled(stream, interval, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(_sink(path)).trigger(**trigger).start()


def read(spark: SparkSession, path: str, interval: str) -> DataFrame:
    """The bars as the stream left them: the newest row of every bucket."""
    rows = spark.read.parquet(path)
    fields = [x for x in rows.columns if x not in ("symbol", "bucket", "batch")]
    newest = rows.groupBy("symbol", "bucket").agg(F.max_by(F.struct(*fields), "batch").alias("r"))
    return newest.select("symbol", c("bucket").alias("open_time"), "r.*", F.lit(interval).alias("interval"))
