"""Mixing sources to target weights as a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1] that runs in a straight line from `first` to `last`
times its share. Its integral is the source's cumulative demand, target * (t + b (t^2 - t)) words with slope
b = (last - first) / (last + first); a document that begins c words into its source's order is due at the t at which that
demand reaches c, which is the root of a quadratic. A source whose target exceeds its size is read a second time, at
most whole, so no document is taken more than twice. Documents stand in the order of md5(doc_id) in their source, and
the result is range-sorted by the first position.

Targets: the sources, by code point and null last, weigh 5, 2, 1, repeating, and share BUDGET times all sizes; a target
stops at CAP times its source's size and the excess goes to the others by weight until none is above. The level that
does this is found in closed form on one row a source.

Defined cases: null text has size 0 and is never taken; null source is a source of its own; a document that the target
cuts off is taken in part, one at most for each source; rows that repeat a doc_id are taken as separate documents in
the order of their text; empty tables give empty results; other columns are ignored by `mix` and carried by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, fresh, text_or_empty

BUDGET, CAP = 1.5, 2
WEIGHTS = (5.0, 2.0, 1.0)
#: First and last multiple of the share, for each place in the cycle of weights.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS}]+")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, slope, target from one row a source (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), place + 1)
    rows = sizes.select("source", "source_size", pick(WEIGHTS).alias("weight"), pick([(b - a) / (a + b) for a, b in SCHEDULES]).alias("slope"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(CAP)))
    # By rising cap per weight, the first sources are full; the level is the words left per weight left.
    filled = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto, whole = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(whole) * F.lit(BUDGET))
    rows = rows.withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    rows = rows.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    rows = rows.withColumn("try_level", F.col("left_words") / F.col("left_weight"))
    level = F.min(F.when(F.col("try_level") * F.col("weight") <= F.col("cap"), F.struct("place", "try_level")))
    rows = rows.withColumn("place", F.row_number().over(filled)).withColumn("level", level.over(whole).getField("try_level"))
    return rows.select("source", "source_size", "weight", "slope", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def due(at: Column, target: Column, slope: Column) -> Column:
    """The time at which the cumulative demand of a source reaches `at` words."""
    q, b = at / target, slope
    root = (b - 1 + F.sqrt((1 - b) * (1 - b) + 4 * b * q)) / (2 * b)
    return F.when(b == 0, q).otherwise(root)


def mix(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position, second_position, first (words of the first reading) and the columns `also`, range-sorted by position."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text_or_empty()).alias("size"), F.xxhash64(text_or_empty()).alias("text_order"), *also)
    rows = rows.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("chunk", F.substring("hash", 1, 3))
    # Words before each document: inside its (source, chunk) by a window, before its chunk by a table of at most 4096 rows a source.
    chunks = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    of = Window.partitionBy("source").orderBy("chunk")
    chunks = chunks.withColumn("before", F.sum("words").over(of) - F.col("words"))
    sources = targets(chunks.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumnRenamed("source", "s")
    starts = chunks.join(sources, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("chunk").alias("c"), "before", "source_size", "slope", "target")
    inside = Window.partitionBy("source", "chunk").orderBy("hash", "doc_id", "text_order", *also).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    rows = rows.withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    goal = F.floor("target")
    part = lambda at: F.least(F.col("size"), F.greatest(F.lit(0), goal - at))
    again = F.col("start") + F.col("source_size")
    rows = rows.withColumn("first", part(F.col("start"))).withColumn("second", part(again))
    rows = rows.withColumn("position", F.when(F.col("first") > 0, due(F.col("start"), F.col("target"), F.col("slope"))))
    rows = rows.withColumn("second_position", F.when(F.col("second") > 0, due(again, F.col("target"), F.col("slope"))))
    out = rows.select("doc_id", "source", "size", "source_size", "target", (F.col("first") + F.col("second")).cast("long").alias("taken"), "position", "second_position", "first", *also)
    # What is not taken has no position; it is spread after the end, by hash.
    last = F.coalesce("position", 1 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    return out.repartitionByRange(last, "doc_id").sortWithinPartitions(last, "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as rows of docs: a document once for each time it is taken, in order of position; what the target cuts off keeps its first words.

    A row is known by 96 bits of hashes of all its columns. Rows that are equal in every column are joined as one to the
    places of all of them, so that k equal rows make k readings and not k * k.
    """
    names = [fresh(docs, n) for n in ("row_hash", "row_hash_too", "full_size", "place", "copy")]
    a, b, size, place, copy = names
    values = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    keyed = docs.withColumns({a: F.xxhash64(*values), b: F.hash(*values)})
    times = F.array(F.struct("position", F.col("first").alias("words")), F.struct(F.col("second_position").alias("position"), (F.col("taken") - F.col("first")).alias("words")))
    plan = mix(keyed, (a, b)).where("taken > 0").select(a, b, F.col("size").alias(size), F.explode(F.filter(times, lambda x: x.words > 0)).alias(place))
    one = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(a, b).orderBy(a))).where(F.col(copy) == 1)
    met = one.join(plan, [a, b])
    pieces = F.split("text", f"(?<=[^{WS}])(?=[{WS}])")  # white space stays before its word
    words = F.col(place).getField("words")
    out = met.withColumn("text", F.when(words < F.col(size), F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    order = [F.col(place).getField("position"), F.col("doc_id"), F.col(a)]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*[f"`{c}`" for c in docs.columns])


def _sql() -> str:
    order = "md5(coalesce(doc_id::varchar, '')), doc_id"
    root = "(slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * ({q}))) / (2 * slope)"
    at = lambda q: f"round(CASE WHEN slope = 0 THEN {q} ELSE {root.format(q=q)} END, 6) + 0.0"
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size,
         md5(coalesce(doc_id::varchar, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::double AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::double AS weight,
             CASE r % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::double AS slope, 2.0::double * source_size AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS place, 1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS lw,
             sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS lg FROM w
      WINDOW o AS (ORDER BY cap / weight, source NULLS LAST), p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by(lw / lg, place) AS level FROM f WHERE lw / lg * weight <= cap),
t AS (SELECT source, source_size, slope, least(cap, coalesce(level * weight, cap)) AS target FROM f CROSS JOIN l),
x AS (SELECT d.doc_id, size, source_size, slope, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, least(size, greatest(0, floor(target) - start)) AS one, least(size, greatest(0, floor(target) - start - source_size)) AS two FROM x)
SELECT doc_id, size, source_size::bigint AS source_size, target, (one + two)::bigint AS taken,
       CASE WHEN one > 0 THEN {at("start / target")} END AS position,
       CASE WHEN two > 0 THEN {at("(start + source_size) / target")} END AS second_position
FROM y"""


SQL = _sql()
