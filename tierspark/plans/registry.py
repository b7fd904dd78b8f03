"""Named queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query reads whole driver tables through a view of
:mod:`tierspark.sources.driver_tables`; the matching SQL is in
:mod:`tierspark.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tierspark.functions.formatting import cluster_name
from tierspark.operators import features as feat
from tierspark.operators import kmeans as km
from tierspark.operators.median import exact_medians
from tierspark.operators.normalize import feature_ranges
from tierspark.operators.scoring import (category_scores as _scores, classify as _classify,
                                         cluster_medians as _medians)
from tierspark.plans import classification_job as cj
from tierspark.plans.feature_job import compute_features
from tierspark.plans.pipeline import run_tiering
from tierspark.schemas import DEFAULT_RULES, FEATURES, NORM_FEATURES
from tierspark.session import materialize, scratch_path
from tierspark.sources import files
from tierspark.sources.driver_tables import VIEWS, embedding_points, load_table

CE = VIEWS["customer_events"]
PL = VIEWS["part_lineitem"]
NO_LOG_END = 1800000000.0


def _features(spark, sf_dir, view=CE):
    return compute_features(view.manifest(spark, sf_dir), view.log(spark, sf_dir), view.width)


# ---- sources ------------------------------------------------------------------

def scan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "manifest-csv")
    files.write_manifest(CE.manifest_text(spark, sf_dir), path)
    return files.read_manifest(spark, path)


def scan_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "log-csv")
    files.write_access_log_text(CE.log_text(spark, sf_dir), path)
    return files.read_access_log(spark, path)


def log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported files with each row's rank by time, taken from where it stands in
    them (files in name order, then lines): rows of one time share their first rank."""
    path = scratch_path(spark, "log-export")
    files.export_log(CE.log_text(spark, sf_dir), path)
    rows = files.read_access_log(spark, path).select(
        "*", F.col("_metadata.file_name").alias("file"),
        F.monotonically_increasing_id().alias("line"))
    sizes = rows.groupBy("file").count()
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    rows = rows.withColumn("place", place).join(F.broadcast(sizes), "file")
    at = rows.withColumn("place", F.col("first") + F.col("place"))
    same = Window.partitionBy("ts_iso")
    return at.select("ts_iso", "path", "op", "client_node", "pid",
                     F.min("place").over(same).alias("time_rank"))


def feature_round_trip(spark, sf_dir):
    """The feature table through its CSV sink and back."""
    path = scratch_path(spark, "features-csv")
    files.write_features(_features(spark, sf_dir).features, path, fmt="csv")
    return files.read_features(spark, path, "csv")


def result_round_trip(spark, sf_dir):
    """The centroid table through its CSV sink and back."""
    path = scratch_path(spark, "result-csv")
    table = centroid_table(spark, sf_dir)
    files.write_table(table, path, fmt="csv", single_file=True)
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.col(c).cast(t) for c, t in table.dtypes])


def parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_access_log(CE.log_text(spark, sf_dir)).select("ts_iso", "path", "ts_epoch")


def parse_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (files.parse_manifest(CE.manifest_text(spark, sf_dir))
            .select("path", "creation_ts", "creation_epoch"))


# ---- features -----------------------------------------------------------------

def op_flags(spark, sf_dir):
    return feat.op_flags(CE.log(spark, sf_dir), CE.manifest(spark, sf_dir))


def access_freq(spark, sf_dir):
    return feat.access_freq(CE.log(spark, sf_dir))


def rw_counts(spark, sf_dir):
    return feat.rw_counts(CE.log(spark, sf_dir))


def bucket_counts(spark, sf_dir):
    return feat.bucket_counts(CE.log(spark, sf_dir), CE.width)


def peak_concurrency(spark, sf_dir):
    return feat.peak_concurrency(CE.log(spark, sf_dir), CE.width)


def observation_end(spark, sf_dir):
    return feat.observation_end(CE.log(spark, sf_dir))


def locality(spark, sf_dir):
    return _features(spark, sf_dir).filled.select(
        "path", "local_accesses", "total_accesses", feat.locality_of().alias("locality"))


def locality_repeated(spark, sf_dir):
    """Manifest rows that repeat a path (the customers of ``orders``): each row has the
    share of its own primary node."""
    o = load_table(spark, sf_dir, "orders")
    node = F.concat(F.lit("dn"), (F.col("o_orderkey") % 3 + 1).cast("string"))
    manifest = o.select(F.col("o_custkey").cast("string").alias("path"),
                        F.lit(0.0).alias("creation_epoch"), node.alias("primary_node"))
    run = compute_features(manifest, CE.log(spark, sf_dir), CE.width)
    return run.filled.select("path", "local_accesses", "total_accesses",
                             feat.locality_of().alias("locality"))


def age_seconds(spark, sf_dir):
    log = CE.log(spark, sf_dir)
    end = feat.resolve_observation_end(feat.observation_end(log).collect()[0][0])
    return feat.age_seconds(CE.manifest(spark, sf_dir), end)


def fill_missing(spark, sf_dir):
    return _features(spark, sf_dir).filled


def write_ratio(spark, sf_dir):
    return _features(spark, sf_dir).features.select("path", "write_ratio")


def feature_table(spark, sf_dir):
    return _features(spark, sf_dir).features.select("path", *FEATURES)


def feature_ranges_q(spark, sf_dir):
    return feature_ranges(_features(spark, sf_dir).features, FEATURES)


def minmax_norm(spark, sf_dir):
    return _features(spark, sf_dir).features


def minmax_norm_lineitem(spark, sf_dir):
    return _features(spark, sf_dir, PL).features


def orphan_features(spark, sf_dir):
    """Most log rows are of no manifest file, and one feature is constant."""
    return _features(spark, sf_dir, VIEWS["supplier_events"]).features


def edge_features(spark, sf_dir):
    """Missing creation times, primary nodes, access times and clients."""
    return _features(spark, sf_dir, VIEWS["edges"]).features


def no_log_features(spark, sf_dir):
    """A manifest whose log has no rows; the observation end is given."""
    log = CE.log(spark, sf_dir).where(F.lit(False))
    return compute_features(CE.manifest(spark, sf_dir), log, CE.width,
                            observation_end=NO_LOG_END).features


# ---- clustering and scoring -------------------------------------------------------


K, SEED, ROUND = 4, 42, 9


def _points(spark, sf_dir, view=CE):
    # written once (short lineage for the seeding passes); not left cached in the
    # caller's session, since the returned plans outlive this call
    feats = _features(spark, sf_dir, view).features.select("path", *NORM_FEATURES)
    return materialize(feats, "points")


def _seeded(spark, sf_dir, view=CE):
    pts = _points(spark, sf_dir, view)
    seeds = km.kmeanspp_seeds(pts, NORM_FEATURES, "path", K, SEED)
    return pts, seeds


def _first_assignment(spark, sf_dir):
    pts, seeds = _seeded(spark, sf_dir)
    return pts, seeds, km.assign(pts, NORM_FEATURES, [s[1] for s in seeds])


def _first_medians(spark, sf_dir):
    # a small final window, so that the selection takes several rounds here too
    return _medians(_first_assignment(spark, sf_dir)[2], NORM_FEATURES, K, window_rows=16)


def kmeanspp_init(spark, sf_dir):
    pts, seeds = _seeded(spark, sf_dir)
    order = spark.createDataFrame([(i, s[0]) for i, s in enumerate(seeds)],
                                  "seed_index int, path string")
    return (pts.join(F.broadcast(order), "path")
            .select("seed_index", "path", *NORM_FEATURES))


def kmeanspp_d2(spark, sf_dir):
    pts, seeds = _seeded(spark, sf_dir)
    return pts.select("path", km.d2_column(NORM_FEATURES, [s[1] for s in seeds[:-1]]).alias("d2"))


def kmeanspp_d2_total(spark, sf_dir):
    pts, seeds = _seeded(spark, sf_dir)
    d2 = km.d2_column(NORM_FEATURES, [s[1] for s in seeds[:-1]])
    return pts.agg(F.round(F.sum(d2), ROUND).alias("d2_total"))


def kmeans_assign(spark, sf_dir):
    return _first_assignment(spark, sf_dir)[2].select("path", "cluster")


def kmeans_lloyd3(spark, sf_dir):
    """Labels after three Lloyd iterations from the k-means++ seeds (no early stop)."""
    pts, seeds = _seeded(spark, sf_dir)
    res = km.kmeans(pts, NORM_FEATURES, "path", K, max_iter=3, tol=0.0,
                    init=[s[1] for s in seeds])
    return res.labeled.select("path", "cluster")


def kmeans_update(spark, sf_dir):
    return km.cluster_stats(_first_assignment(spark, sf_dir)[2], NORM_FEATURES, K)


def kmeans_shift(spark, sf_dir):
    _, seeds, labeled = _first_assignment(spark, sf_dir)
    means, _ = km.update(labeled, NORM_FEATURES, K)
    shift = km.frobenius_shift(means, [s[1] for s in seeds])
    return spark.createDataFrame([(shift,)], "shift double").select(
        F.round("shift", ROUND).alias("shift"))


def cluster_rows(spark, sf_dir):
    labeled = _first_assignment(spark, sf_dir)[2]
    return labeled.where(F.col("cluster") == 0).select("path", *NORM_FEATURES)


def cluster_medians(spark, sf_dir):
    return _first_medians(spark, sf_dir)


def category_scores(spark, sf_dir):
    return _scores(_first_medians(spark, sf_dir), DEFAULT_RULES)


def classify_clusters(spark, sf_dir):
    return _classify(_first_medians(spark, sf_dir), DEFAULT_RULES)


def _centroid_table(spark, sf_dir, view):
    """The job's output table after the first assignment."""
    pts, seeds = _seeded(spark, sf_dir, view)
    labeled = km.assign(pts, NORM_FEATURES, [s[1] for s in seeds])
    means, _ = km.update(labeled, NORM_FEATURES, K)
    cats = _classify(_medians(labeled, NORM_FEATURES, K), DEFAULT_RULES).collect()
    return cj.centroid_table(spark, [m or s[1] for m, s in zip(means, seeds)],
                             {r["cluster"]: r["category"] for r in cats})


def centroid_table(spark, sf_dir):
    return _centroid_table(spark, sf_dir, CE)


def centroid_table_lineitem(spark, sf_dir):
    return _centroid_table(spark, sf_dir, PL)


def kmeans_fit(spark, sf_dir):
    pts = _points(spark, sf_dir)
    res = km.kmeans(pts, NORM_FEATURES, "path", K, seed=SEED)
    return res.labeled.select("path", "cluster")


def tiering_pipeline(spark, sf_dir):
    return run_tiering(CE.manifest(spark, sf_dir), CE.log(spark, sf_dir), CE.width, K,
                       seed=SEED).table


def file_categories(spark, sf_dir):
    return run_tiering(CE.manifest(spark, sf_dir), CE.log(spark, sf_dir), CE.width, K,
                       seed=SEED).files


def kmeans_fit_lineitem(spark, sf_dir):
    pts = _points(spark, sf_dir, PL)
    return km.kmeans(pts, NORM_FEATURES, "path", K, seed=SEED).labeled.select("path", "cluster")


def _far_init(spark, sf_dir):
    """Three seeds, and a centre that no point is near."""
    pts, seeds = _seeded(spark, sf_dir)
    return pts, [s[1] for s in seeds[:K - 1]] + [[9.0] * len(NORM_FEATURES)]


def kmeans_empty_cluster(spark, sf_dir):
    """Centres after one iteration: the empty cluster's is a point drawn anew."""
    pts, init = _far_init(spark, sf_dir)
    res = km.kmeans(pts, NORM_FEATURES, "path", K, max_iter=1, seed=SEED, init=init)
    return spark.createDataFrame(
        [(j, n, *c) for j, (n, c) in enumerate(zip(res.counts, res.centroids))],
        "cluster int, n long, " + ", ".join(f"{c} double" for c in NORM_FEATURES))


def kmeans_empty_clusters(spark, sf_dir):
    """Three empty clusters of one iteration, each re-seeded with a point of its own draw."""
    pts, seeds = _seeded(spark, sf_dir)
    far = [[9.0 + j] * len(NORM_FEATURES) for j in range(3)]
    res = km.kmeans(pts, NORM_FEATURES, "path", K + 2, max_iter=1, seed=SEED,
                    init=[s[1] for s in seeds[:K - 1]] + far)
    return spark.createDataFrame(
        [(j, n, *c) for j, (n, c) in enumerate(zip(res.counts, res.centroids))],
        "cluster int, n long, " + ", ".join(f"{c} double" for c in NORM_FEATURES))


RAW = ["age_seconds", "access_freq"]


def _raw_fit(spark, sf_dir):
    pts = _features(spark, sf_dir).features.select("path", *[F.col(c).cast("double").alias(c) for c in RAW])
    return km.kmeans(materialize(pts, "raw-points"), RAW, "path", K, seed=SEED)


def kmeans_raw(spark, sf_dir):
    """Labels of a fit on ages in seconds and access counts as they are."""
    return _raw_fit(spark, sf_dir).labeled.select("path", "cluster")


def kmeans_raw_centres(spark, sf_dir):
    res = _raw_fit(spark, sf_dir)
    return spark.createDataFrame(
        [(j, n, *c) for j, (n, c) in enumerate(zip(res.counts, res.centroids))],
        "cluster int, n long, " + ", ".join(f"{c} double" for c in RAW))


def path_medians(spark, sf_dir):
    """Exact medians per path: as many groups as files."""
    log = PL.log(spark, sf_dir).select(
        "path", "ts_epoch", (F.col("ts_epoch") / 86400.0).alias("day"),
        (F.round(F.col("ts_epoch") / 86400).cast("long") % 7).cast("double").alias("hash_day"))
    return exact_medians(log, ["path"], ["ts_epoch", "day", "hash_day"], window_rows=24)


def empty_cluster_categories(spark, sf_dir):
    pts, init = _far_init(spark, sf_dir)
    return _classify(_medians(km.assign(pts, NORM_FEATURES, init), NORM_FEATURES, K), DEFAULT_RULES)


def point_count(spark, sf_dir):
    n = km.check_points(_points(spark, sf_dir), NORM_FEATURES)
    return spark.createDataFrame([(n,)], "n long")


def cluster_names(spark, sf_dir):
    labeled = _first_assignment(spark, sf_dir)[2]
    return labeled.select("path", cluster_name(F.col("cluster")).alias("name"))


def scores_cubed(spark, sf_dir):
    """Category scores with another deviation weight, f(x) = x^3."""
    return _scores(_first_medians(spark, sf_dir), DEFAULT_RULES, f=lambda x: x * x * x)


_CLUSTER_QUERIES = {
    "kmeans_fit_lineitem": kmeans_fit_lineitem,
    "kmeans_empty_cluster": kmeans_empty_cluster,
    "kmeans_empty_clusters": kmeans_empty_clusters,
    "kmeans_raw": kmeans_raw,
    "kmeans_raw_centres": kmeans_raw_centres,
    "path_medians": path_medians,
    "empty_cluster_categories": empty_cluster_categories,
    "point_count": point_count,
    "cluster_names": cluster_names,
    "scores_cubed": scores_cubed,
    "kmeanspp_init": kmeanspp_init,
    "kmeanspp_d2": kmeanspp_d2,
    "kmeanspp_d2_total": kmeanspp_d2_total,
    "kmeans_assign": kmeans_assign,
    "kmeans_lloyd3": kmeans_lloyd3,
    "kmeans_update": kmeans_update,
    "kmeans_shift": kmeans_shift,
    "cluster_rows": cluster_rows,
    "cluster_medians": cluster_medians,
    "category_scores": category_scores,
    "classify_clusters": classify_clusters,
    "centroid_table": centroid_table,
    "kmeans_fit": kmeans_fit,
    "tiering_pipeline": tiering_pipeline,
    "file_categories": file_categories,
}

# ---- embeddings as a second point set --------------------------------------------


EMBED_K = 10


def _embed_seeded(spark, sf_dir):
    pts, cols = embedding_points(spark, sf_dir)
    pts = materialize(pts, "embedding-points")
    return pts, cols, km.kmeanspp_seeds(pts, cols, "vec", EMBED_K, SEED)


def embedding_kmeanspp_init(spark, sf_dir):
    pts, cols, seeds = _embed_seeded(spark, sf_dir)
    order = spark.createDataFrame([(i, s[0]) for i, s in enumerate(seeds)],
                                  "seed_index int, vec string")
    return pts.join(F.broadcast(order), "vec").select("seed_index", "vec", *cols)


def embedding_kmeans_assign(spark, sf_dir):
    pts, cols, seeds = _embed_seeded(spark, sf_dir)
    return km.assign(pts, cols, [s[1] for s in seeds]).select("vec", "cluster")


def embedding_kmeans_update(spark, sf_dir):
    pts, cols, seeds = _embed_seeded(spark, sf_dir)
    return km.cluster_stats(km.assign(pts, cols, [s[1] for s in seeds]), cols, EMBED_K)


def global_medians(spark, sf_dir):
    return exact_medians(_points(spark, sf_dir), [], NORM_FEATURES, window_rows=16)


_CLUSTER_QUERIES.update({
    "global_medians": global_medians,
    "centroid_table_lineitem": centroid_table_lineitem,
    "embedding_kmeanspp_init": embedding_kmeanspp_init,
    "embedding_kmeans_assign": embedding_kmeans_assign,
    "embedding_kmeans_update": embedding_kmeans_update,
})

_FEATURE_QUERIES = {
    "scan_manifest": scan_manifest,
    "scan_access_log": scan_access_log,
    "parse_ts": parse_ts,
    "parse_creation": parse_creation,
    "log_export": log_export,
    "op_flags": op_flags,
    "access_freq": access_freq,
    "rw_counts": rw_counts,
    "bucket_counts": bucket_counts,
    "peak_concurrency": peak_concurrency,
    "observation_end": observation_end,
    "locality": locality,
    "locality_repeated": locality_repeated,
    "orphan_features": orphan_features,
    "edge_features": edge_features,
    "no_log_features": no_log_features,
    "feature_round_trip": feature_round_trip,
    "result_round_trip": result_round_trip,
    "age_seconds": age_seconds,
    "fill_missing": fill_missing,
    "write_ratio": write_ratio,
    "feature_table": feature_table,
    "feature_ranges": feature_ranges_q,
    "minmax_norm": minmax_norm,
    "minmax_norm_lineitem": minmax_norm_lineitem,
}


def queries() -> dict:
    """All registered queries, ``name -> f(spark, sf_dir)``."""
    out = dict(_FEATURE_QUERIES)
    out.update(_CLUSTER_QUERIES)
    return out
