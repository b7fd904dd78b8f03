"""Print the executed physical plans of the main stages (AQE final plans).

Usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tierspark.operators import features as feat  # noqa: E402
from tierspark.operators import kmeans as km  # noqa: E402
from tierspark.plans.feature_job import compute_features  # noqa: E402
from tierspark.schemas import NORM_FEATURES  # noqa: E402
from tierspark.session import build_session, materialize  # noqa: E402
from tierspark.sources.driver_tables import VIEWS  # noqa: E402


def show(title, df):
    df.write.format("noop").mode("overwrite").save()
    print(f"\n===== {title} =====")
    df.explain("formatted")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=8)
    v = VIEWS["part_lineitem"]
    m, log = v.manifest(spark, sf_dir), v.log(spark, sf_dir)
    show("per-path statistics (one pass over the log)", feat.file_stats(m, log, v.width))
    run = compute_features(m, log, v.width)
    pts = materialize(run.features.select("path", *NORM_FEATURES), "explain-points", persist=True)
    seeds = [s[1] for s in km.kmeanspp_seeds(pts, NORM_FEATURES, "path", 4, 42)]
    lab = km.assign(pts, NORM_FEATURES, seeds)
    show("Lloyd update", km.cluster_stats(lab, NORM_FEATURES, 4))
    show("row flags", feat.op_flags(log, m))


if __name__ == "__main__":
    main()
