"""Exact quantiles of everything that came before a row, for histories that no task holds.

A history is cut into chunks of rows in time. Beside it stands a structure over the values: buckets between approximate quantiles (and
one for each such quantile itself, so that a value of which there are very many needs no list), and for every chunk how many values of
each bucket came before it. Inside a chunk of m rows a quantile's rank moves by m at most, so of all that came before only the values
of some 2 m ranks can be an answer: their buckets follow from the counts, and only these buckets' values of earlier chunks are brought
to the chunk. There the ranks are read from a sorted list into which the chunk's own rows are inserted one by one.

A task holds one chunk's rows and that many values; the counts are (chunks x buckets), no more than a few times the rows, as a chunk
has at least the square root of the longest history.
"""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled

c = F.col
#: Rows of a chunk, for histories of up to its square.
CHUNK = 4096


def _bucketed(pdf: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
    """Bucket 2 i lies between cut i - 1 and cut i, bucket 2 i + 1 is cut i itself."""
    at = np.unique(np.asarray(cuts["cuts"].iloc[0], float)) if len(cuts) and cuts["cuts"].iloc[0] is not None else np.zeros(0)
    v = pdf["v"].to_numpy(float)
    return pdf.assign(bucket=np.searchsorted(at, v, "left") + np.searchsorted(at, v, "right"))


def _reading(keys: list[str], probs: list[float]):
    names = [f"q_{k}" for k in range(len(probs))]

    def run(rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        rows, blocks = rows.sort_values("pos"), blocks.sort_values("bucket")
        n = int(blocks["known"].iloc[0]) if len(blocks) else 0
        lists: list[list[float]] = []
        lows: list[int] = []
        for k in range(len(probs)):
            lo, hi = (int(blocks[f"{x}_{k}"].iloc[0]) for x in ("lo", "hi")) if n else (0, -1)
            held: list[float] = []
            for start, size, value, values in zip(blocks["start"], blocks["before"], blocks["value"], blocks["values"], strict=True):
                first, last = max(lo, start) - start, min(hi, start + size - 1) - start + 1
                if first < last:
                    held += [value] * (last - first) if values is None or not len(values) else np.sort(values)[first:last].tolist()
            lists.append(held)
            lows.append(lo)
        trimmed, history, out = [lo > 0 for lo in lows], [], [[] for _ in probs]
        for v in rows["v"].tolist():
            history.append(n)
            for k, q in enumerate(probs):
                if not n:
                    out[k].append(None)
                    continue
                at = q * (n - 1)
                low = int(at)
                x = lists[k][low - lows[k]]
                out[k].append(x if at == low else (low + 1 - at) * x + (at - low) * lists[k][low + 1 - lows[k]])
            if v == v:  # not a number: unknown
                n += 1
                for k, held in enumerate(lists):
                    if trimmed[k] and v < held[0]:
                        lows[k] += 1
                    else:
                        insort(held, v)
        return rows[[*keys, "pos"]].assign(history=history, **dict(zip(names, (pd.Series(x, dtype=float, index=rows.index) for x in out), strict=True)))

    return run


def expanding(rows: DataFrame, keys: list[str], value: str, probs: list[float], size: int | None = None) -> DataFrame:
    """keys, pos, history and q_0, q_1, ... of rows that `pos` numbers from 0 within keys.

    history counts the values of strictly earlier rows that are known (neither null nor not a number), and q_k is their quantile
    probs[k], interpolated between neighbours; null where there is none.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    rows = settled(rows.select(*keys, "pos", F.nanvl(c(value).cast("double"), F.lit(None).cast("double")).alias("v")))
    longest = (rows.agg(F.max("pos")).first()[0] or 0) + 1  # one number
    size = size or max(CHUNK, math.isqrt(longest - 1) + 1)
    buckets = -(-longest // size)
    rows = rows.withColumn("part", F.floor(c("pos") / size))
    place, cell = [*keys, "part"], [*keys, "bucket"]

    counted = rows.groupBy(*place).agg(F.count("v").alias("fresh"))
    w = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = settled(counted.withColumn("known", F.coalesce(F.sum("fresh").over(w), F.lit(0))))

    probes = F.array(*[F.lit(k / buckets) for k in range(1, buckets)]) if buckets > 1 else None
    cuts = F.percentile_approx("v", probes, 10 * buckets) if buckets > 1 else F.array().cast("array<double>")
    cuts = parts.select(*place).join(rows.groupBy(*keys).agg(cuts.alias("cuts")), keys) if buckets > 1 else parts.select(*place, cuts.alias("cuts"))
    known = rows.where("v IS NOT NULL").groupBy(*place).cogroup(cuts.groupBy(*place)).applyInPandas(lambda a, b: _bucketed(a, b), f"{kinds}, pos long, v double, part long, bucket long")
    known = settled(known.select(*keys, "pos", "v", "part", "bucket"))

    counts = known.groupBy(*place, "bucket").agg(F.count(F.lit(1)).alias("n"))
    values = known.groupBy(*cell).agg(F.min("v").alias("value"), F.collect_list(F.when(c("bucket") % 2 == 0, F.struct("pos", "v"))).alias("held"))
    grid = parts.where("known > 0").join(counts.select(*cell).distinct(), keys).join(counts, [*place, "bucket"], "left")
    earlier = Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    grid = parts.where("known = 0").select(*place).join(counts, place).select(*place, "bucket", "n", F.lit(None).cast("long").alias("fresh"), F.lit(0).cast("long").alias("known")).unionByName(grid.select(*place, "bucket", "n", "fresh", "known"))
    grid = grid.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("known > 0 AND before > 0")
    smaller = Window.partitionBy(*place).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("start", F.coalesce(F.sum("before").over(smaller), F.lit(0)))
    for k, q in enumerate(probs):
        low = F.greatest(F.lit(0), F.floor(F.lit(q) * (c("known") - 1)) - c("fresh"))
        high = F.least(c("known") - 1, F.ceil(F.lit(q) * (c("known") + c("fresh") - 1)) + 1)
        grid = grid.withColumns({f"lo_{k}": low.cast("long"), f"hi_{k}": high.cast("long")})
    wanted = F.greatest(*[(c("start") <= c(f"hi_{k}")) & (c("start") + c("before") > c(f"lo_{k}")) for k in range(len(probs))])
    earlier_values = F.transform(F.filter("held", lambda x: x["pos"] < c("part") * size), lambda x: x["v"])
    ranges = [f"{x}_{k}" for k in range(len(probs)) for x in ("lo", "hi")]
    blocks = grid.where(wanted).join(values, cell).select(*place, "bucket", "known", "start", "before", *ranges, "value", earlier_values.alias("values"))
    read = _reading(keys, probs)
    shape = f"{kinds}, pos long, history long, {', '.join(f'q_{k} double' for k in range(len(probs)))}"
    return rows.groupBy(*place).cogroup(blocks.groupBy(*place)).applyInPandas(lambda a, b: read(a, b), shape)


def whole(rows: DataFrame, keys: list[str], value: str, q: float, out: str, share: int = 1000) -> DataFrame:
    """keys and the exact quantile of their values, interpolated: of each group only the few values around it are sorted.

    An approximate quantile a little lower and one a little higher enclose the wanted ranks, as ranks are counted in a second pass; values
    between them, about 6 in `share`, are numbered. Values equal to the lower bound are counted, not listed.
    """
    rows = rows.select(*keys, c(value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = F.percentile_approx("v", F.array(F.lit(max(0.0, q - 2 / share)), F.lit(min(1.0, q + 2 / share))), share)
    marks = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ends.alias("ends"), F.min("v").alias("least"), F.max("v").alias("most"))
    marks = marks.withColumns({"low": F.when(c("n") <= share, c("least")).otherwise(c("ends")[0]), "high": F.when(c("n") <= share, c("most")).otherwise(c("ends")[1])}).drop("ends", "least", "most")
    met = rows.join(marks, keys)
    below = met.groupBy(*keys).agg(F.count_if(c("v") < c("low")).alias("below"))
    inside = met.where("v BETWEEN low AND high").groupBy(*keys, "v", "n").agg(F.count(F.lit(1)).alias("times")).join(below, keys)
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    at = F.lit(q) * (c("n") - 1)
    ranked = inside.withColumn("upto", c("below") + F.sum("times").over(w)).withColumn("from", c("upto") - c("times"))
    pick = lambda rank: F.max(F.when((c("from") <= rank) & (rank < c("upto")), c("v")))
    got = ranked.groupBy(*keys).agg(pick(F.floor(at)).alias("a"), pick(F.ceil(at)).alias("b"), F.max(at - F.floor(at)).alias("part"))
    return got.select(*keys, F.when(c("a") == c("b"), c("a")).otherwise(c("a") + (c("b") - c("a")) * c("part")).alias(out))
