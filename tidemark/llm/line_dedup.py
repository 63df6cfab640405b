"""Line dedup: hashes of lines in ranges, sorted inside by document and position, and a keep bitmap a document.

Every line that has a key becomes a row (hash, part, document, position), where part is one of as many slices of the documents as a
shuffle has partitions. Rows are range-partitioned by (hash, part) and sorted inside by document and position, so one pass over
neighbours finds the first line of each document with that hash and the first of all, and a line that a third of all documents hold
is spread over its parts. Per hash only the number of documents and the place of its first line are gathered, with partial sums.
The hashes that go are joined back to their rows, and what a document loses is kept as the runs of lines that stay: a bitmap in run
form, from which texts are cut only where somebody wants texts.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, with A-Z lower-cased; keys are equal when their 128-bit digests are.

Defined cases: null and empty texts are one empty line; lines with a key of fewer than `least_chars` code points never go; rows with
equal doc_id and text are one document, counted once, each returned; rows that share only a doc_id, also null, are documents of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Documents from which a key's lines go, and the least length of such a key.
LEAST_DOCS, LEAST_CHARS = 10, 1
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    """The key of a line; texts of ASCII alone take the quick way to lower case, which for them is the same."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and `id`, 16 bytes that tell documents apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.withColumn("id", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))))


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """h, doc_id, id, pos, of_document: the lines that may go, in ranges of their hashes; of_document marks a document's first with that hash."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _identified(docs).select("doc_id", "id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", key_of(F.col("line")))
    rows = rows.where(F.length("key") >= max(1, least_chars)).select(F.unhex(F.md5("key")).alias("h"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "id", "pos")
    w = Window.partitionBy("h", "part").orderBy("doc_id", "id", "pos")
    rows = rows.repartitionByRange("h", "part").withColumns({"last_id": F.lag("id").over(w), "last_pos": F.lag("pos").over(w)})
    of_document = ~F.col("last_id").eqNullSafe(F.col("id"))
    rows = rows.withColumn("of_document", of_document).where(of_document | (F.col("last_pos") != F.col("pos")))  # rows that repeat a document go here
    return rows.select("h", "doc_id", "id", "pos", "of_document")


def dropped(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """id, gone: the sorted positions of the lines that each document loses; documents that lose none are left out."""
    found = written(occurrences(docs, least_chars))
    totals = found.groupBy("h").agg(F.count_if("of_document").alias("docs"), F.min(F.struct("doc_id", "id", "pos")).alias("first"))
    going = written(totals.where(F.col("docs") >= least_docs).select("h", "first"))
    gone = found.join(going, "h")
    if keep_first:
        gone = gone.where(F.struct("doc_id", "id", "pos") != F.col("first"))
    return gone.groupBy("id").agg(F.sort_array(F.collect_list("pos")).alias("gone"))


def keep_runs(gone: Column, n_lines: Column) -> Column:
    """The runs (first, length) of lines that stay, from the sorted positions of those that go."""
    starts = F.filter(gone, lambda p, i: (i == 0) | (F.get(gone, i - 1) != p - 1))
    ends = F.filter(gone, lambda p, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != p + 1))
    runs = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1)), F.concat(starts, F.array(n_lines)), lambda a, b: F.struct(a.alias("first"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def decided(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_runs and the text; a plan that does not look at the text does not move it.

    Lines whose key at least `least_docs` documents hold go, all of them or (`keep_first`) all but the first by document and position.
    """
    rows = _identified(docs).withColumn("n_lines", F.size(F.split("text", "\n")))
    met = rows.join(dropped(docs, least_docs, least_chars, keep_first), "id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    return met.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), keep_runs(F.col("gone"), F.col("n_lines")).alias("keep_runs"), "text")


def bitmaps(docs: DataFrame, **rule) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_runs of every document."""
    return decided(docs, **rule).drop("text")


def kept_text(text: Column, runs: Column) -> Column:
    """The lines of the runs, joined."""
    lines = F.split(text, "\n")
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["first"] + 1, r["length"]))), "\n")


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
