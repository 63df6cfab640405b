"""Long series as many tasks: row numbers without one task a series, and windows over chunks with a halo of rows.

A window over (symbol) is one task a symbol. Here every row gets its number in its series from counts by time chunk, the
series is cut into chunks of CHUNK rows, and each chunk also gets the last rows of the one before (or the first of the one
after) that a bounded window can look at. Rows of the halo are dropped when the windows are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 4096
#: Partitions to which few groups are dealt, so that two of them seldom meet in one.
LEAST_DEALT = 64
c = F.col
KEYS = ["symbol", "interval"]


def indexed(bars: DataFrame, keys: list[str] = KEYS, order: str = "open_time", days: int = 32, out: str = "idx") -> DataFrame:
    """bars with `idx`, the row's number from 0 in its series in time order."""
    return _counted(bars, keys, order, F.floor(F.unix_seconds(order) / (86400 * days)), out)


def dealt(rows: DataFrame, *keys: str, groups: int | None = None) -> DataFrame:
    """rows dealt by keys (or evenly) to a stated number of partitions, which adaptive execution does not merge: for work that is heavy for its bytes.

    groups: the number of different keys, where it is known. Partitions then do not grow with the session's setting beyond what groups can fill.
    """
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n if groups is None else min(n, max(LEAST_DEALT, 2 * groups)), *keys)


def numbered(rows: DataFrame, keys: list[str], order: str = "idx", out: str = "pos", size: int = CHUNK) -> DataFrame:
    """rows with `pos`, gapless numbers from 0 in the order of a whole number of which a series may lack some."""
    return _counted(rows, keys, order, F.floor(F.col(order) / size), out)


def _counted(rows: DataFrame, keys: list[str], order: str, part: Column, out: str) -> DataFrame:
    rows = rows.withColumn("__part", part)
    counts = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__part").orderBy(order)
    return rows.withColumn("__row", F.row_number().over(inside) - 1).join(starts, [*keys, "__part"]).withColumn(out, (F.col("__start") + F.col("__row")).cast("long")).drop("__part", "__row", "__start")


def carried(rows: DataFrame, kind: str, named: dict[str, Column], keys: list[str], order: str = "pos", size: int = CHUNK) -> DataFrame:
    """rows with running values up to and including each row: of kind `sum`, `max`, or `last` (the last one that is known).

    A value is found inside its chunk and joined to that of the chunks before, one row a chunk.
    """
    whole, running, joined = {
        "sum": (F.sum, F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + here),
        "max": (F.max, F.max, F.greatest),
        "last": (lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))), lambda v: F.last(v, ignorenulls=True), lambda before, here: F.coalesce(here, before)),
    }[kind]
    rows = rows.withColumns({"__part": F.floor(F.col(order) / size)} | {f"__v_{k}": v for k, v in named.items()})
    chunks = rows.groupBy(*keys, "__part").agg(*[whole(f"__v_{k}").alias(f"__c_{k}") for k in named])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*keys, "__part", *[running(f"__c_{k}").over(before).alias(f"__b_{k}") for k in named])
    inside = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumns({f"__h_{k}": running(f"__v_{k}").over(inside) for k in named}).join(chunks, [*keys, "__part"])
    out = met.withColumns({k: joined(F.col(f"__b_{k}"), F.col(f"__h_{k}")) for k in named})
    return out.drop("__part", *[f"__{x}_{k}" for x in "vbh" for k in named])


def beside(rows: DataFrame, named: dict[str, Callable[[WindowSpec], Column]], keys: list[str], order: str = "pos", back: int = 0, ahead: int = 0) -> DataFrame:
    """rows with columns that look at most `back` rows before and `ahead` rows after; each value takes the window."""
    w = over(keys=keys, order=order)
    return done(chunked(rows, back, ahead, order=order).withColumns({k: f(w) for k, f in named.items()}))


def chunked(rows: DataFrame, back: int, ahead: int = 0, size: int = CHUNK, order: str = "idx") -> DataFrame:
    """rows (numbered without gaps) beside copies for the neighbouring chunks whose windows look `back` and `ahead` rows."""
    size = max(size, back, ahead)
    own, within = F.floor(F.col(order) / size), F.col(order) % size
    places = [F.when(within >= size - back, own + 1)] * bool(back) + [F.when(within < ahead, own - 1)] * bool(ahead)
    if not places:
        return rows.withColumn("chunk", own).withColumn("own", F.lit(True))
    out = rows.withColumn("chunk", F.explode(F.array_compact(F.array(own, *places))))
    return out.withColumn("own", F.col("chunk") == F.floor(F.col(order) / size))


def done(rows: DataFrame) -> DataFrame:
    return rows.where("own").drop("own", "chunk")


def over(first: int | None = None, last: int = 0, keys: list[str] = KEYS, order: str = "idx") -> WindowSpec:
    w = Window.partitionBy(*keys, "chunk").orderBy(order)
    return w if first is None else w.rowsBetween(first, last)


def full(agg: Column, value: Column, n: int, keys: list[str] = KEYS) -> Column:
    """agg over the last n rows, null until there are n values."""
    w = over(-(n - 1), 0, keys)
    return F.when(F.count(value).over(w) == n, agg.over(w))


#: Rows of a chunk inside which powers of a mean's decay, taken from the chunk's middle, stay within doubles for spans from 2 on.
DECAY_CHUNK = 1024


def _decayed(x: Column, span: int, keys: list[str]) -> tuple[Column, Column, Column]:
    """Of the values of a chunk up to each row: their sum weighed as a mean weighs new values, their number, and the first of them."""
    b, w = 1 - 2.0 / (span + 1), over(Window.unboundedPreceding, 0, keys)
    n = F.count(x).over(w)
    place = (n - DECAY_CHUNK // 2).cast("double")
    return F.sum(x * (1 - b) * F.pow(F.lit(1 / b), place)).over(w) * F.pow(F.lit(b), place), n, F.first(x, ignorenulls=True).over(w)


def ewm(x: Column, span: int, before: Column, keys: list[str] = KEYS) -> Column:
    """Recursive exponentially weighted mean with alpha = 2 / (span + 1), seeded with the first value that is not null.

    Nulls are passed over and have no mean themselves. Rows are in chunks of at most DECAY_CHUNK own rows; rows of a halo do not count.
    before: the mean before the chunk (`ewm_before`), null where there is none. In a chunk y = b^n y_before + the chunk's own sum.
    """
    own = F.when(c("own"), x)
    if span == 1:
        return own
    grown, n, first = _decayed(own, span, keys)
    return F.when(own.isNotNull(), F.coalesce(grown + F.pow(F.lit(1 - 2.0 / (span + 1)), n.cast("double")) * F.coalesce(before, first), own))


def _composed(maps: Column, start: Column) -> Column:
    """One affine map (a, b, first value) after another: y -> a + b y."""
    after = lambda one, two: F.struct((two["a"] + two["b"] * one["a"]).alias("a"), (one["b"] * two["b"]).alias("b"), F.coalesce(one["first"], two["first"]).alias("first"))
    return F.aggregate(maps, start, after)


def ewm_before(rows: DataFrame, named: dict[str, tuple[Column, int]], keys: list[str] = KEYS, order: str = "idx", wide: int = 512) -> DataFrame:
    """keys, chunk and for every name (value, span) the mean before each chunk: affine maps of chunks, composed in order.

    Chunks are composed inside groups of `wide`, and groups after one another, so a list holds `wide` chunks or one map a group.
    """
    none = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(None).cast("double").alias("first"))
    parts = {}
    for name, (x, span) in named.items():
        grown, n, first = _decayed(F.when(c("own"), x.cast("double")), max(span, 2), keys)
        parts |= {f"__a_{name}": F.coalesce(grown, F.lit(0.0)), f"__n_{name}": n, f"__f_{name}": first}
    last = lambda x: F.max_by(x, order)
    ends = rows.withColumns(parts).where("own").groupBy(*keys, "chunk").agg(*[last(f"__{x}_{name}").alias(f"__{x}_{name}") for name in named for x in "anf"])
    made = {name: F.struct(c(f"__a_{name}").alias("a"), F.pow(F.lit(1 - 2.0 / (max(span, 2) + 1)), c(f"__n_{name}").cast("double")).alias("b"), c(f"__f_{name}").alias("first")) for name, (_, span) in named.items()}
    maps = ends.select(*keys, "chunk", F.floor(c("chunk") / wide).alias("__group"), *[m.alias(name) for name, m in made.items()])
    listed = F.sort_array(F.collect_list(F.struct("chunk", *named)))
    groups = maps.groupBy(*keys, "__group").agg(listed.alias("__all")).select(*keys, "__group", *[_composed(c(f"__all.{name}"), none).alias(name) for name in named])
    earlier = Window.partitionBy(*keys).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*keys, "__group", *[_composed(F.collect_list(name).over(earlier), none).alias(f"__s_{name}") for name in named])
    inside = Window.partitionBy(*keys, "__group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    out = maps.withColumns({f"__l_{name}": F.collect_list(name).over(inside) for name in named}).join(groups, [*keys, "__group"])
    at = {name: _composed(c(f"__l_{name}"), c(f"__s_{name}")) for name in named}
    return out.select(*keys, "chunk", *[(m["a"] + m["b"] * m["first"]).alias(name) for name, m in at.items()])
