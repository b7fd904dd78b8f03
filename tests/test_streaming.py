"""The streaming bucket counts give the same features as the batch job."""

import os

from tierspark.plans.feature_job import compute_features
from tierspark.sources import files
from tierspark.streaming import features_from_buckets, read_log_stream, start_bucket_sink


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_stream_buckets_match_batch_features(spark, tmp_out):
    logdir = f"{tmp_out}/incoming"
    first = [f"2025-01-01T00:00:{s:02d}.{ms:03d}Z,/f{s % 3},{'WRITE' if s % 4 == 0 else 'READ'},dn{s % 2 + 1},1"
             for s in range(0, 50) for ms in (0, 500)]
    manifest = spark.createDataFrame([("/f0", 0.0, "dn1"), ("/f1", 10.0, "dn2"), ("/f2", 20.0, "dn1")],
                                     "path string, creation_epoch double, primary_node string")
    # the second file is late, and has rows without a time
    later = ["2025-01-01T01:00:00.000Z,/f0,READ,dn1,1", "2025-01-01T00:00:03.100Z,/f1,WRITE,dn2,1",
             "not-a-time,/f2,READ,dn1,1", ",/f2,READ,dn1,1"]
    for name, lines in (("part-1", first), ("part-2", later)):
        _write(f"{logdir}/{name}.csv", lines)
        stream = read_log_stream(spark, logdir)
        q = start_bucket_sink(stream, f"{tmp_out}/buckets", f"{tmp_out}/ckpt", width=10.0,
                              available_now=True)
        q.awaitTermination(120)

    log = files.parse_access_log(files.read_access_log(spark, logdir))
    batch = compute_features(manifest, log, 10.0).features
    streamed = features_from_buckets(manifest, spark.read.parquet(f"{tmp_out}/buckets")).features
    assert sorted(map(tuple, streamed.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
