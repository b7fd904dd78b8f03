"""Classification job: feature table -> clusters -> categories -> centroid table.

The normalised points are written once under the shared checkpoint folder and
kept persisted for the iterations; k-means++ uses k aggregate passes, every
Lloyd iteration one; the per-cluster medians are an exact distributed
selection; scores, categories and the output table are tiny lazy plans.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tierspark.functions.formatting import centroid_id_text
from tierspark.operators import kmeans as km
from tierspark.operators.scoring import (category_scores, classify, cluster_medians,
                                         global_medians)
from tierspark.schemas import DEFAULT_RULES, NORM_FEATURES, Rules
from tierspark.session import materialize, release, scratch_scope


def centroid_table(spark: SparkSession, centroids, categories: dict, cols=NORM_FEATURES
                   ) -> DataFrame:
    """``centroid_id, category`` + the centroid's features, one row per cluster: k rows
    the driver already holds (``categories``: category by cluster number)."""
    fields = [T.StructField("centroid_id", T.StringType()), T.StructField("category", T.StringType())]
    return spark.createDataFrame(
        [(centroid_id_text(c), categories.get(j), *map(float, c)) for j, c in enumerate(centroids)],
        T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in cols]))


@dataclass
class ClassificationRun:
    table: DataFrame          # centroid_id, category, features
    files: DataFrame          # path, cluster, category (per file)
    kmeans: km.KMeansResult
    medians: DataFrame
    scores: DataFrame
    categories: DataFrame
    points: DataFrame | None = None   # written points, if the lineage was cut

    def close(self) -> None:
        """Delete the written points; ``files`` cannot be read afterwards (the other
        frames hold k rows each)."""
        release(self.points)


def classify_files(features: DataFrame, k: int = 4, rules: Rules = DEFAULT_RULES,
                   cols=NORM_FEATURES, id_col: str = "path", seed: int = 42,
                   tol: float = 1e-4, max_iter: int | None = None,
                   medians_from: str = "rules", cut_lineage: bool = True,
                   method: str = "lloyd") -> ClassificationRun:
    """End-to-end classification of a feature table.

    ``cut_lineage=True`` writes the points under the checkpoint folder before
    the iterations; ``False`` only persists them (for inputs that are already a
    short plan over written files, as :func:`compute_features` returns).
    ``medians_from='data'`` replaces the rule set's global medians with the
    exact medians of the points. ``method='mllib'`` clusters with Spark ML's
    KMeans (k-means|| seeding, its own convergence rule) instead of the
    k-means++ / Lloyd operators.
    """
    cols = list(cols)
    points = features.select(id_col, *cols)
    if cut_lineage:
        points = materialize(points, "points", persist=True)
    else:
        points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = km.check_points(points, cols)
        if n < k:
            raise ValueError(f"k={k} clusters need at least as many files, got {n}")
        if method == "mllib":
            centers, labeled = km.mllib_kmeans(points, cols, k, seed=seed,
                                               max_iter=max_iter or max(100, n // 100), tol=tol)
            means, counts = km.update(labeled, cols, k)
            res = km.KMeansResult([m if m is not None else c for m, c in zip(means, centers)],
                                  labeled, 0, [], centers, counts, tuple(cols))
        elif method == "lloyd":
            res = km.kmeans(points, cols, id_col, k, max_iter=max_iter, tol=tol, seed=seed)
        else:
            raise ValueError(f"unknown method {method!r}")
        if medians_from == "data":
            rules = Rules(rules.features, global_medians(points, cols), rules.weights,
                          rules.directions, rules.replication_factors, rules.categories,
                          rules.moderate, rules.moderate_band)
        spark = features.sparkSession
        with scratch_scope(spark):  # k rows: kept here, so that their tables can go
            meds = cluster_medians(res.labeled, cols, k)
            meds = spark.createDataFrame(meds.collect(), meds.schema)
        scores = category_scores(meds, rules)
        # k rows: resolved now, while the points are still persisted
        cat_rows = {r["cluster"]: r["category"] for r in classify(meds, rules).collect()}
        cats = spark.createDataFrame(sorted(cat_rows.items()), "cluster int, category string")
        table = centroid_table(spark, res.centroids, cat_rows, cols)
        files = res.labeled.select(id_col, "cluster").join(F.broadcast(cats), "cluster", "left")
        return ClassificationRun(table, files, res, meds, scores, cats,
                                 points if cut_lineage else None)
    finally:
        # results stay valid: they recompute the points from files if used later
        points.unpersist()


def main(argv=None) -> None:
    from tierspark.session import build_session, size_shuffle_partitions
    from tierspark.sources.files import read_features, write_table

    ap = argparse.ArgumentParser(description="Cluster files and assign storage categories.")
    ap.add_argument("--input_path", required=True, help="feature table: file, folder or glob")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--k", type=int, default=4)
    ap.add_argument("--output_csv", default="final_categories.csv")
    ap.add_argument("--files_out", default=None, help="also write path, cluster, category")
    ap.add_argument("--seed", type=int, default=42)
    ap.add_argument("--method", default="lloyd", choices=["lloyd", "mllib"])
    ap.add_argument("--medians_from", default="rules", choices=["rules", "data"])
    ap.add_argument("--rules", default=None,
                    help="JSON rule set (keys as Rules.to_dict); defaults to the built-in rules")
    a = ap.parse_args(argv)
    spark = build_session(app="tierspark-classify")
    rules = DEFAULT_RULES
    if a.rules:
        import json
        text = spark.read.text(a.rules, wholetext=True).first()[0]  # any path Spark reads
        rules = Rules.from_dict(json.loads(text))
    feats = read_features(spark, a.input_path, a.format)
    size_shuffle_partitions(spark, feats)
    run = classify_files(feats, a.k, rules, seed=a.seed, method=a.method,
                         medians_from=a.medians_from)
    write_table(run.table, a.output_csv, fmt="csv", single_file=True)
    if a.files_out:
        write_table(run.files, a.files_out, fmt="parquet")
    run.close()
    print(f"{a.k} clusters with their categories: {a.output_csv}")


if __name__ == "__main__":
    main()
