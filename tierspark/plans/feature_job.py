"""Feature job: manifest + access log -> feature table with min-max norms.

Two Spark actions in total:

1. materialise the per-path statistics table (:func:`file_stats`), which reads
   the log once;
2. one global aggregate over that (manifest-sized) table, giving the
   observation end, the mean writes and all ten normalisation bounds.

The features and norms are then a lazy projection with those scalars as
literals. Bounds of derived features follow from monotonicity and are exactly
what a second pass would compute: ``min(w / mu) = min(w) / mu`` for ``mu > 0``
and ``min(end - c) = end - max(c)`` (both are correctly rounded, monotone
operations).
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tierspark.operators import features as feat
from tierspark.operators.normalize import minmax_normalize
from tierspark.schemas import NORM_OF
from tierspark.session import materialize, release


@dataclass
class FeatureRun:
    features: DataFrame          # path, 5 features, 5 norms
    filled: DataFrame            # per manifest file counts after the zero fill
    stats: DataFrame             # materialised per-path statistics
    observation_end: float
    mean_writes: float
    ranges: dict                 # {feature: (min, max)}
    n_files: int

    def close(self) -> None:
        """Delete the statistics table; the frames above cannot be read afterwards."""
        release(self.stats)


def check_unique_paths(manifest: DataFrame) -> None:
    twice = manifest.groupBy("path").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"manifest path is not unique: {twice[0]['path']!r} has "
                         f"{twice[0]['count']} rows")


def compute_features(manifest: DataFrame, log: DataFrame | None, width: float = 1.0,
                     observation_end: float | None = None, check_unique: bool = False,
                     cut_lineage: bool = True, stats: DataFrame | None = None) -> FeatureRun:
    """Features from a manifest and a raw log, or from a precomputed per-path
    statistics table ``stats`` (:func:`features.file_stats_from`)."""
    if check_unique:
        check_unique_paths(manifest)
    if stats is None:
        stats = feat.file_stats(manifest, log, width)
    if cut_lineage:
        stats = materialize(stats, "file-stats")

    # one global aggregate, written as SQL text (one call into the JVM)
    af = "coalesce(access_freq, 0)"
    wr = "coalesce(writes, 0)"
    conc = "coalesce(max_concurrency, 0)"
    loc = (f"CASE WHEN {af} > 0 THEN CAST(coalesce(local_accesses, 0) AS DOUBLE) "
           f"/ CAST(access_freq AS DOUBLE) ELSE 1.0D END")

    def m(expr):
        return f"CASE WHEN in_manifest THEN {expr} END"

    g = stats.selectExpr(
        "max(last_ts) AS obs",
        f"avg({m(wr)}) AS mu",
        f"min({m(af)}) AS min_af", f"max({m(af)}) AS max_af",
        f"min({m(wr)}) AS min_w", f"max({m(wr)}) AS max_w",
        f"min({m('creation_epoch')}) AS min_c", f"max({m('creation_epoch')}) AS max_c",
        f"count({m('CASE WHEN creation_epoch IS NULL THEN 1 END')}) AS n_null_c",
        f"min({m(loc)}) AS min_loc", f"max({m(loc)}) AS max_loc",
        f"min({m(conc)}) AS min_con", f"max({m(conc)}) AS max_con",
        f"count({m('1')}) AS n_files",
    ).collect()[0]

    obs = feat.resolve_observation_end(g["obs"], observation_end)
    mu = feat.mean_writes_or_one(g["mu"])
    ages = []
    if g["max_c"] is not None:
        ages += [obs - float(g["max_c"]), obs - float(g["min_c"])]
    if g["n_null_c"]:
        ages.append(0.0)
    ranges = {
        "access_freq": (g["min_af"], g["max_af"]),
        "age_seconds": (min(ages), max(ages)) if ages else (None, None),
        "write_ratio": ((float(g["min_w"]) / mu, float(g["max_w"]) / mu)
                        if g["min_w"] is not None else (None, None)),
        "locality": (g["min_loc"], g["max_loc"]),
        "concurrency": (g["min_con"], g["max_con"]),
    }
    filled = feat.fill_missing(stats, obs)
    raw = feat.feature_columns(filled, mu)
    normed = minmax_normalize(raw, NORM_OF, ranges)
    return FeatureRun(normed, filled, stats, obs, mu, ranges, int(g["n_files"]))


def main(argv=None) -> None:
    from tierspark.session import build_session, size_shuffle_partitions
    from tierspark.sources.files import (parse_access_log, parse_manifest, read_access_log,
                                         read_manifest, write_features)

    ap = argparse.ArgumentParser(description="Per-file access features with min-max norms.")
    ap.add_argument("--manifest", required=True)
    ap.add_argument("--access_log", required=True)
    ap.add_argument("--out", default="features_out")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--bucket_seconds", type=float, default=1.0)
    ap.add_argument("--single_file", action="store_true")
    ap.add_argument("--check_unique", action="store_true")
    a = ap.parse_args(argv)
    spark = build_session(app="tierspark-features")
    manifest = parse_manifest(read_manifest(spark, a.manifest))
    log = parse_access_log(read_access_log(spark, a.access_log))
    size_shuffle_partitions(spark, manifest, log)
    run = compute_features(manifest, log, a.bucket_seconds, check_unique=a.check_unique)
    write_features(run.features, a.out, fmt=a.format, single_file=a.single_file)
    run.close()
    print("feature table:", a.out)


if __name__ == "__main__":
    main()
