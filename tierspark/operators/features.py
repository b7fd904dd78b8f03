"""Per-file access features.

Inputs (parsed forms, see :mod:`tierspark.sources`):

* manifest: ``path, creation_epoch, primary_node`` (``path`` is the key);
* log: ``path, ts_epoch, op, client_node``.

Plan shape. The log is the big input. It is read once: one grouping-sets aggregate
counts it by (path, bucket) and by (path, client node), combining in each task
before the exchange, so a hot path spreads over its buckets and clients. The manifest's
(path, primary node) pairs enter that aggregate as rows that count nothing, so each
(path, client) group knows whether its client is a primary node of the path; only such
clients reach the aggregate by path, however many clients a path has. The raw log is
never joined.

Everything after that is per file (manifest-sized) and joins on ``path``.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from tierspark.session import materialize

WRITE, READ = "WRITE", "READ"


def _is(op: str):
    return F.when(F.col("op") == F.lit(op), F.lit(1)).otherwise(F.lit(0))


#: A path is hot from this share of the log on, and gets a part for each such share.
HOT_SHARE = 1 / 1000


def hot_paths(log: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """``path, parts`` of the paths with more than ``share`` of the log's rows (fewer than
    ``1 / share`` of them): the number of parts that brings each below that share. One
    aggregate by path, combined in each task, written once."""
    counts = materialize(log.where("path IS NOT NULL").groupBy("path").agg(
        F.count(F.lit(1)).alias("n")), "path-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > total * share).select(
        "path", F.ceil(F.col("n") / F.lit(max(1.0, total * share))).cast("int").alias("parts"))


def op_flags(log: DataFrame, manifest: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """Row-level flags: is_write, is_read, is_local (client == primary node).

    A log row whose path is not in the manifest keeps a NULL primary node and is
    not local; an op that is neither READ nor WRITE is neither; a NULL client is
    not local.

    Only hot paths (:func:`hot_paths`, a bounded table sent to all tasks) are salted:
    their log rows are dealt over their parts by time and client, each part meeting a
    copy of the manifest row. Rows without a path match nothing and are dealt alike.
    """
    hot = F.broadcast(hot_paths(log, share))
    m = manifest.where("path IS NOT NULL").select("path", "primary_node").join(
        hot, "path", "left").select("path", "primary_node", F.explode(F.sequence(
            F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    parts = F.when(F.col("path").isNull(), F.lit(int(1 / share))).otherwise(
        F.coalesce("parts", F.lit(1)))
    salt = F.pmod(F.xxhash64("ts_epoch", "client_node", "op"), parts).cast("int")
    return log.join(hot, "path", "left").withColumn("salt", salt).join(
        m, ["path", "salt"], "left").select(
        "path", "ts_epoch", "op", "client_node", "primary_node",
        _is(WRITE).alias("is_write"), _is(READ).alias("is_read"),
        F.when(F.col("client_node") == F.col("primary_node"), F.lit(1))
        .otherwise(F.lit(0)).alias("is_local"))


def access_freq(log: DataFrame) -> DataFrame:
    """Accesses per path (every log path, including ones not in the manifest)."""
    return log.groupBy("path").agg(F.count(F.lit(1)).alias("access_freq"))


def rw_counts(log: DataFrame) -> DataFrame:
    """Writes and reads per path (conditional sums)."""
    return log.groupBy("path").agg(F.sum(_is(WRITE)).cast("long").alias("writes"),
                                   F.sum(_is(READ)).cast("long").alias("reads"))


def bucket_of(width: float = 1.0):
    """Time bucket of a log row: ``floor(ts_epoch / width)``; NULL times share
    one NULL bucket per path."""
    if float(width) == 1.0:
        return F.floor(F.col("ts_epoch"))
    return F.floor(F.col("ts_epoch") / F.lit(float(width)))


def bucket_counts(log: DataFrame, width: float = 1.0) -> DataFrame:
    """Accesses per (path, time bucket)."""
    return (log.groupBy(F.col("path"), bucket_of(width).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def peak_concurrency(log: DataFrame, width: float = 1.0) -> DataFrame:
    """Largest bucket count per path (two-level aggregate)."""
    return (bucket_counts(log, width).groupBy("path")
            .agg(F.max("n").alias("max_concurrency")))


def log_counts(log: DataFrame, width: float = 1.0) -> DataFrame:
    """Log rows as counts: path, bucket, client_node, n, w, r, t."""
    return log.select("path", bucket_of(width).alias("bucket"), "client_node",
                      F.lit(1).cast("long").alias("n"), _is(WRITE).cast("long").alias("w"),
                      _is(READ).cast("long").alias("r"), F.col("ts_epoch").alias("t"))


def path_table(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per path, from one pass over (possibly already summed) counts:
    ``path, access_freq, writes, reads, max_concurrency, last_ts, primaries``, where
    ``primaries`` holds (client node, accesses) of the path's primary nodes only: one
    entry, or as many as the manifest repeats the path with other nodes. Paths of the
    manifest without an access have a row of NULLs."""
    asked = manifest.where("path IS NOT NULL AND primary_node IS NOT NULL").select(
        "path", F.col("primary_node").alias("client_node"), F.lit(True).alias("primary"))
    rows = counts.unionByName(asked, allowMissingColumns=True)
    sets = [["path", "bucket"], ["path", "client_node"]]
    both = rows.groupingSets(sets, "path", "bucket", "client_node").agg(
        F.grouping("client_node").alias("by_bucket"), F.sum("n").alias("n"),
        F.sum("w").alias("w"), F.sum("r").alias("r"), F.max("t").alias("t"),
        F.max("primary").alias("primary"))
    by_bucket = F.col("by_bucket") == 1
    local = F.when(~by_bucket & F.col("primary"), F.struct("client_node", "n"))
    return both.groupBy("path").agg(
        F.sum(F.when(by_bucket, F.col("n"))).alias("access_freq"),
        F.sum(F.when(by_bucket, F.col("w"))).alias("writes"),
        F.sum(F.when(by_bucket, F.col("r"))).alias("reads"),
        F.max(F.when(by_bucket, F.col("n"))).alias("max_concurrency"),
        F.max("t").alias("last_ts"), F.collect_list(local).alias("primaries"))


def observation_end(log: DataFrame) -> DataFrame:
    """Latest access time over the whole log (paths outside the manifest too)."""
    return log.agg(F.max("ts_epoch").alias("observation_end"))


def file_stats(manifest: DataFrame, log: DataFrame, width: float = 1.0) -> DataFrame:
    """Per-path table over manifest and log paths (full outer join on path):
    ``path, in_manifest, creation_epoch, access_freq, writes, reads,
    max_concurrency, last_ts, local_accesses``. Log-only paths are kept so that
    the observation end covers them; features use ``in_manifest`` rows only.
    """
    return file_stats_from(manifest, path_table(log_counts(log, width), manifest))


def file_stats_from(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    """:func:`file_stats` from :func:`path_table` rows. Manifest rows that repeat a path
    share its counts; each has the local accesses of its own primary node."""
    m = manifest.select("path", "creation_epoch", "primary_node", F.lit(True).alias("in_manifest"))
    local = F.expr("coalesce(try_element_at(filter(primaries, c -> c.client_node = primary_node), 1).n, "
                   "if(primaries IS NULL, NULL, 0L))")
    return m.join(paths, "path", "full").select(
        "path", F.coalesce("in_manifest", F.lit(False)).alias("in_manifest"),
        "creation_epoch", "access_freq", "writes", "reads", "max_concurrency", "last_ts",
        local.alias("local_accesses"))


def age_seconds(manifest: DataFrame, observation_end: float) -> DataFrame:
    """``observation_end - creation_epoch``; NULL creation gives NULL."""
    return manifest.select("path", (F.lit(float(observation_end)) - F.col("creation_epoch"))
                           .alias("age_seconds"))


def resolve_observation_end(value, override: float | None = None) -> float:
    """The collected latest access time, or ``override``, or the wall clock when
    the log has no parsable time at all."""
    if override is not None:
        return float(override)
    if value is None:
        return time.time()
    return float(value)


def fill_missing(stats: DataFrame, observation_end: float) -> DataFrame:
    """Manifest files with their counts; never-accessed files get zeros and an
    unparsable creation time gives age 0."""
    t = stats.where(F.col("in_manifest")).select(
        "path", "access_freq", "writes", "reads", "local_accesses",
        F.col("access_freq").alias("total_accesses"), "max_concurrency",
        (F.lit(float(observation_end)) - F.col("creation_epoch")).alias("age_seconds"))
    return t.na.fill({"access_freq": 0, "writes": 0, "reads": 0, "local_accesses": 0,
                      "total_accesses": 0, "max_concurrency": 0, "age_seconds": 0})


def mean_writes_or_one(mu) -> float:
    """Mean writes per manifest file; 0 or undefined becomes 1.0."""
    if mu is None or mu == 0:
        return 1.0
    return float(mu)


def locality_of(local: str = "local_accesses", total: str = "total_accesses") -> Column:
    """Share of local accesses; 1.0 for a file without any access."""
    return (F.when(F.col(total) > 0, F.col(local).cast("double") / F.col(total).cast("double"))
            .otherwise(F.lit(1.0)))


def feature_columns(filled: DataFrame, mean_writes: float) -> DataFrame:
    """The five raw features from the filled table."""
    return filled.select(
        "path", "access_freq", "age_seconds",
        (F.col("writes").cast("double") / F.lit(float(mean_writes))).alias("write_ratio"),
        locality_of().alias("locality"),
        F.col("max_concurrency").alias("concurrency"),
    )
