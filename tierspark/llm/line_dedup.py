"""Line dedup: keep bitmaps from range-partitioned line hashes.

Every line long enough to count becomes one row (hash, document, position), written once,
since range partitioning reads its input twice. The rows are range-partitioned by (hash,
slice of documents) and sorted by document and position inside; a running window streams
the first document of each (hash, slice). Lines of any other document in the group are
dropped there. The first documents of the slices go through the same step once more by
hash alone, which settles the rest. There are about as many slices as the root of the
number of lines (at least 64), so a line in all of N documents is groups of N / slices
rows, then one of ``slices`` rows.

What comes back per document is a run-length coded keep bitmap. The bitmaps go to the texts
if they are at most ``BROADCAST_BYTES``; else both are shuffled by document.

Defined cases
* null or empty text: one empty line, which is kept.
* a null ``doc_id`` counts as the largest id; rows that repeat a ``doc_id`` are one
  document (none of them drops lines for another of them), each gets its own result row.
* a very long text is one row of lines; its lines are rows of their own until the bitmap.
* keys shorter than ``min_chars`` code points are never dropped.
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, order_id, whole_text

BLANKS = " \t\n\x0b\f\r"
#: Largest size of the bitmaps, in memory, that is sent to every task.
BROADCAST_BYTES = 32_000_000


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def line_rows(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per countable line: d, th (text hash), pos, h1, h2."""
    t = docs.select(order_id().alias("d"), whole_text().alias("t"))
    t = t.select("d", F.xxhash64("t").alias("th"), F.posexplode(_lines(ascii_lower(F.col("t"))))
                 .alias("pos", "line"))
    t = t.withColumn("key", F.btrim("line", F.lit(BLANKS)))
    t = t.where(F.char_length("key") >= min_chars)
    return t.select("d", "th", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))


def _with_first(rows: DataFrame, *group: str) -> DataFrame:
    """Range partition on the group, then stream the group's first document."""
    w = (Window.partitionBy(*group).orderBy("d", "pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.repartitionByRange(*group).withColumn("first", F.first("d").over(w))


def dropped_lines(docs: DataFrame, min_chars: int = 10, slices: int | None = None) -> DataFrame:
    """Rows (d, th, pos) of the lines that go."""
    rows = materialize(line_rows(docs, min_chars), "lines")
    slices = slices or max(64, isqrt(rows.count()))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("d"), F.lit(slices)))
    local = _with_first(rows, "h1", "h2", "slice")
    later = local.where("d > first")
    heads = local.where("d = first").select("d", "th", "pos", "h1", "h2")
    beaten = _with_first(heads, "h1", "h2").where("d > first")
    return later.select("d", "th", "pos").unionByName(beaten.select("d", "th", "pos"))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(d, th, drops, rle): ``rle`` holds the lengths of kept and dropped runs in turn,
    starting with a kept run; lines after the last run are kept."""
    w = Window.partitionBy("d", "th").orderBy("pos")
    runs = (dropped.withColumn("run", F.col("pos") - F.dense_rank().over(w))
            .groupBy("d", "th", "run")
            .agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi")))
    packed = runs.groupBy("d", "th").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("drops"),
        F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    rle = F.expr("flatten(transform(runs, (r, i) -> array("
                 "r.lo - if(i = 0, 0, runs[i - 1].hi), r.hi - r.lo)))")
    return packed.select("d", "th", "drops", rle.alias("rle"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, slices: int | None = None,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_rle, kept_text."""
    maps = materialize(keep_bitmaps(dropped_lines(docs, min_chars, slices)), "line-maps")
    size = maps.agg(F.sum(F.size("rle") * 8 + 64)).first()[0] or 0
    maps = F.broadcast(maps) if size <= broadcast_bytes else maps.hint("shuffle_hash")
    t = docs.select("doc_id", order_id().alias("d"), whole_text().alias("t"))
    t = t.withColumn("th", F.xxhash64("t"))
    j = t.join(maps, ["d", "th"], "left")
    flags = F.expr("flatten(transform(rle, (n, i) -> array_repeat(i % 2 = 1, n)))")
    j = j.withColumn("lines", _lines(F.col("t"))).withColumn("gone", flags)
    kept = F.expr("array_join(filter(lines, (l, i) -> not coalesce(get(gone, i), false)), '\n')")
    return j.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce("drops", F.lit(0)).cast("long").alias("n_dropped"),
                    F.col("rle").alias("keep_rle"),
                    F.when(F.col("rle").isNull(), F.col("t")).otherwise(kept).alias("kept_text"))


def op1_line_dedup(spark, sf_dir):
    """The lines of all ``documents``: counts before and dropped, hash of what is kept."""
    from .common import documents
    r = dedup_lines(documents(spark, sf_dir))
    return r.select("doc_id", "n_lines", "n_dropped",
                    F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
      FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first, false) AS gone
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
