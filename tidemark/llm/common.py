"""What the operators of this subpackage share: reading, cutting lineage, bounded Arrow batches, gapless positions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rules, as a regular expression class body.
WS = r"\x20\x09-\x0D"
#: Bytes of an Arrow batch.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master, where it is unset, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if spark.conf.get("spark.checkpoint.dir", None) is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared folder, so that a lost executor costs no recomputation of what stands before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Computes df once, into a Parquet table in the shared folder: for narrow rows, whose real size the next joins then know.

    Rows that hold long arrays go through `checkpoint` instead, as Parquet's readers take thousands of rows at a time.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches of about BATCH_BYTES.

    Spark's default of 64 MB makes a batch of whole texts the largest thing that a Python worker and the JVM beside it hold.
    Spark has this bound as a setting of the session alone, so the default is lowered there; any other value stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its own names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def positions(df: DataFrame, group: list[str], order: list[Column], chunk: Column, out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each group, in the order (chunk, *order), without a task that holds a whole group.

    Rows are numbered inside (group, chunk); a small table of counts, one row for each (group, chunk), gives where each
    chunk begins. chunk must follow the order wanted or be a hash of a row's identity.
    """
    df = df.withColumn("__chunk", chunk)
    counts = df.groupBy(*group, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__chunk").orderBy(*order)
    return (
        df.withColumn("__row", F.row_number().over(inside) - 1)
        .join(starts, [*group, "__chunk"])
        .withColumn(out, (F.col("__start") + F.col("__row")).cast("long"))
        .drop("__chunk", "__row", "__start")
    )
