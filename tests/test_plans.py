"""Plan shapes that matter at scale (checked on the physical plan text)."""

import re

from tierspark.functions.hashing import uniform01
from tierspark.operators import features as feat
from tierspark.operators import kmeans as km
from tierspark.schemas import NORM_FEATURES
from tierspark.sources.driver_tables import VIEWS
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_has_no_pairwise_join_and_prunes_the_log(spark):
    v = VIEWS["part_lineitem"]
    fs = feat.file_stats(v.manifest(spark, SF_SMALL), v.log(spark, SF_SMALL), v.width)
    p = plan(fs)
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    scans = re.findall(r"FileScan parquet [^\n]*lineitem[^\n]*", p)
    assert len(scans) == 1                       # one narrow scan, no row-level log join
    for s in scans:
        assert "l_quantity" not in s and "l_extendedprice" not in s and "l_tax" not in s
    assert "partial_sum" in p                    # combined map-side before the exchange


def test_csv_log_is_parsed_once(spark, tmp_out):
    from tierspark.sources import files
    v = VIEWS["customer_events"]
    files.write_access_log_text(v.log_text(spark, SF_SMALL), f"{tmp_out}/log")
    log = files.parse_access_log(files.read_access_log(spark, f"{tmp_out}/log"))
    p = plan(feat.file_stats(v.manifest(spark, SF_SMALL), log, v.width))
    assert len(re.findall("FileScan csv", p)) == 1


def test_no_key_of_the_log_is_unsplit_in_op_flags(spark):
    v = VIEWS["customer_events"]
    p = plan(feat.op_flags(v.log(spark, SF_SMALL), v.manifest(spark, SF_SMALL)))
    for keys in re.findall(r"hashpartitioning\(([^)]*)\)", p):
        assert "salt" in keys


def test_lloyd_update_is_one_aggregate_without_join(spark):
    df = spark.createDataFrame([(str(i), *[i / 10.0] * 5) for i in range(20)],
                               "path string, " + ", ".join(f"{c} double" for c in NORM_FEATURES))
    lab = km.assign(df, NORM_FEATURES, [[0.0] * 5, [1.0] * 5])
    p = plan(km.cluster_stats(lab, NORM_FEATURES, 2))
    assert "partial_sum" in p and "Cartesian" not in p and "NestedLoop" not in p


def test_seed_pick_is_an_aggregate_not_a_sort(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(50)], "id string, x double")
    q = df.agg(__import__("pyspark.sql.functions", fromlist=["min_by"]).min_by(
        "id", uniform01(1, 0, "id")))
    p = plan(q)
    # a keyless aggregate (SortAggregate only because the buffer holds a string):
    # no Sort operator, no window, no join; each task reduces to one row
    assert not re.search(r"(^|[ -])Sort \[", p, re.M)
    assert "Window" not in p and "Join" not in p
    assert "SinglePartition" in p
