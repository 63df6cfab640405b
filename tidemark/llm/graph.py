"""Connected components of links as joins, with lineage cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. Only ids that occur in a link have a row.

    Each round takes the least label among the neighbours and then the label's own label, so long chains close in a
    logarithm of their length. Only the number of changed labels comes to the driver.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("m"))
        met = labels.join(near, labels.id == near.u).select("id", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        above = labels.select(F.col("id").alias("now"), F.col("component").alias("up"))
        jumped = met.join(above, "now").select("id", "was", F.least("now", "up").alias("component"))
        after = written(jumped)
        changed = after.where("component <> was").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels


def merged(reach: DataFrame, links: DataFrame) -> DataFrame:
    """reach after further links (a, b): only the components that these links touch go through the rounds again."""
    of = lambda c: reach.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = reach.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    fresh = joined.join(reach.select("id"), "id", "left_anti")
    return written(moved.select("id", F.coalesce("to", "component").alias("component")).unionByName(fresh))
