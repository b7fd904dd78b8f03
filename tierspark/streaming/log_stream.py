"""Incremental log aggregation with Structured Streaming.

An access log that keeps arriving as CSV files in a folder is reduced, batch by
batch, to one row per (path, client node, time bucket): accesses, writes, reads
and the last access time. Each micro-batch writes its counts to a folder of its
own (overwritten if the batch is repeated after a failure, so every log row
counts once). Counts of different batches for the same bucket are added when the
feature job reads them, so late rows and rows without a time (which share one NULL
bucket) count as in the batch job, and no bucket is ever open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierspark.operators.features import file_stats_from, log_counts, path_table
from tierspark.plans.feature_job import FeatureRun, compute_features
from tierspark.schemas import ACCESS_LOG_TEXT
from tierspark.sources.files import parse_access_log


def read_log_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None
                    ) -> DataFrame:
    """Streaming read of headerless log CSV files with the fixed schema, parsed."""
    r = spark.readStream.schema(ACCESS_LOG_TEXT).option("header", False)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return parse_access_log(r.csv(path))


def start_bucket_sink(log: DataFrame, out_path: str, checkpoint_path: str, width: float = 1.0,
                      available_now: bool = False, processing_time: str | None = None):
    """Start writing ``batch=<id>`` folders of bucket counts under ``out_path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        counts = (log_counts(batch, width).groupBy("path", "client_node", "bucket")
                  .agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("r").alias("r"),
                       F.max("t").alias("t")))
        counts.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    w = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def features_from_buckets(manifest: DataFrame, buckets: DataFrame, **kw) -> FeatureRun:
    """The feature job on the written counts instead of the raw log."""
    stats = file_stats_from(manifest, path_table(buckets, manifest))
    return compute_features(manifest, None, stats=stats, **kw)


def main(argv=None) -> None:
    import argparse

    from tierspark.session import build_session

    ap = argparse.ArgumentParser(description="Aggregate an arriving access log into time buckets.")
    ap.add_argument("--log_dir", required=True, help="folder the log CSV files arrive in")
    ap.add_argument("--out", required=True, help="Parquet folder of bucket counts")
    ap.add_argument("--checkpoint", required=True, help="stream checkpoint folder (shared storage)")
    ap.add_argument("--bucket_seconds", type=float, default=1.0)
    ap.add_argument("--once", action="store_true", help="process what is there, then stop")
    ap.add_argument("--trigger", default="1 minute")
    a = ap.parse_args(argv)
    spark = build_session(app="tierspark-log-stream")
    q = start_bucket_sink(read_log_stream(spark, a.log_dir), a.out, a.checkpoint, a.bucket_seconds,
                          available_now=a.once, processing_time=None if a.once else a.trigger)
    q.awaitTermination()


if __name__ == "__main__":
    main()
