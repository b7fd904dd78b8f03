"""Hand fixtures for the feature semantics."""

import time

import pytest
from pyspark.sql import functions as F

from tierspark.operators import features as feat
from tierspark.plans.feature_job import compute_features

M_SCHEMA = "path string, creation_epoch double, primary_node string"
L_SCHEMA = "path string, ts_epoch double, op string, client_node string"


def frames(spark, manifest, log):
    return (spark.createDataFrame(manifest, M_SCHEMA), spark.createDataFrame(log, L_SCHEMA))


def by_path(df):
    return {r["path"]: r.asDict() for r in df.collect()}


def test_orphan_log_rows_set_observation_end_but_drop_out(spark):
    m, log = frames(spark, [("a", 0.0, "dn1")],
                    [("a", 10.0, "READ", "dn1"), ("zzz", 50.5, "READ", "dn2")])
    run = compute_features(m, log)
    assert run.observation_end == 50.5
    out = by_path(run.features)
    assert list(out) == ["a"]
    assert out["a"]["age_seconds"] == 50.5
    assert out["a"]["access_freq"] == 1


def test_duplicate_manifest_path_is_rejected(spark):
    m, log = frames(spark, [("a", 0.0, "dn1"), ("a", 0.0, "dn1")], [("a", 1.0, "READ", "dn1")])
    with pytest.raises(ValueError, match="not unique"):
        compute_features(m, log, check_unique=True)


def test_repeated_manifest_path_keeps_locality_a_share(spark):
    m, log = frames(spark, [("a", 0.0, "dn1"), ("a", 0.0, "dn1"), ("a", 5.0, "dn2"), ("b", 0.0, "dn2")],
                    [("a", 1.0, "READ", "dn1"), ("a", 2.0, "READ", "dn1"), ("a", 2.5, "READ", "dn2"),
                     ("b", 1.0, "READ", "dn1")])
    rows = compute_features(m, log).features.collect()
    assert sorted(r["locality"] for r in rows) == [0.0, 1 / 3, 2 / 3, 2 / 3]
    assert {r["access_freq"] for r in rows if r["path"] == "a"} == {3}


def test_one_null_path_is_unique(spark):
    from tierspark.plans.feature_job import check_unique_paths
    m, _ = frames(spark, [(None, 0.0, "dn1"), ("a", 0.0, "dn1")], [])
    check_unique_paths(m)


def test_log_rows_without_a_path_are_not_local(spark):
    m, log = frames(spark, [("a", 0.0, "dn1"), (None, 0.0, "dn1")],
                    [(None, 1.0, "READ", "dn1"), ("a", 1.0, "WRITE", "dn1")])
    got = sorted((str(r["path"]), r["is_local"], r["is_write"]) for r in
                 feat.op_flags(log, m).collect())
    assert got == [("None", 0, 0), ("a", 1, 1)]


def test_empty_log_uses_wall_clock_or_override(spark):
    m, log = frames(spark, [("a", 100.0, "dn1"), ("b", 200.0, "dn2")], [])
    before = time.time()
    run = compute_features(m, log)
    assert before <= run.observation_end <= time.time() + 1
    run = compute_features(m, log, observation_end=1000.0)
    out = by_path(run.features)
    assert out["a"]["age_seconds"] == 900.0 and out["b"]["age_seconds"] == 800.0
    assert out["a"]["age_norm"] == 1.0 and out["b"]["age_norm"] == 0.0


def test_bad_creation_time_gives_age_zero(spark):
    m, log = frames(spark, [("a", None, "dn1"), ("b", 5.0, "dn1")], [("a", 10.0, "READ", "dn1")])
    out = by_path(compute_features(m, log).features)
    assert out["a"]["age_seconds"] == 0.0
    assert out["b"]["age_seconds"] == 5.0
    # ranges include the filled zero
    assert out["a"]["age_norm"] == 0.0 and out["b"]["age_norm"] == 1.0


def test_null_times_share_one_bucket(spark):
    m, log = frames(spark, [("a", 0.0, "dn1")],
                    [("a", None, "READ", "dn1"), ("a", None, "READ", "dn1"),
                     ("a", None, "WRITE", "dn1"), ("a", 3.5, "READ", "dn1")])
    assert by_path(feat.peak_concurrency(log))["a"]["max_concurrency"] == 3
    out = by_path(compute_features(m, log).features)
    assert out["a"]["concurrency"] == 3 and out["a"]["access_freq"] == 4


def test_unknown_op_counts_in_frequency_only(spark):
    m, log = frames(spark, [("a", 0.0, "dn1")],
                    [("a", 1.0, "DELETE", "dn1"), ("a", 2.0, "WRITE", "dn1"), ("a", 3.0, None, "dn1")])
    rw = by_path(feat.rw_counts(log))["a"]
    assert (rw["writes"], rw["reads"]) == (1, 0)
    run = compute_features(m, log)
    assert by_path(run.filled)["a"]["access_freq"] == 3


def test_null_client_or_primary_is_not_local(spark):
    m, log = frames(spark, [("a", 0.0, "dn1"), ("b", 0.0, None)],
                    [("a", 1.0, "READ", None), ("a", 2.0, "READ", "dn1"),
                     ("b", 1.0, "READ", "dn1"), ("b", 2.0, "READ", None)])
    out = by_path(compute_features(m, log).features)
    assert out["a"]["locality"] == 0.5
    assert out["b"]["locality"] == 0.0
    flags = [r["is_local"] for r in feat.op_flags(log, m).collect()]
    assert sorted(flags) == [0, 0, 0, 1]


def test_never_accessed_file(spark):
    m, log = frames(spark, [("a", 0.0, "dn1"), ("b", 0.0, "dn2")],
                    [("a", 1.0, "WRITE", "dn2"), ("a", 1.2, "WRITE", "dn2")])
    out = by_path(compute_features(m, log).features)
    b = out["b"]
    assert (b["access_freq"], b["concurrency"], b["write_ratio"], b["locality"]) == (0, 0, 0.0, 1.0)
    # mean writes over all manifest files (zeros included): 2 / 2 = 1
    assert out["a"]["write_ratio"] == 2.0
    assert out["a"]["locality"] == 0.0


def test_no_writes_anywhere_divides_by_one(spark):
    m, log = frames(spark, [("a", 0.0, "dn1")], [("a", 1.0, "READ", "dn1")])
    run = compute_features(m, log)
    assert run.mean_writes == 1.0
    assert by_path(run.features)["a"]["write_ratio"] == 0.0


def test_constant_feature_normalises_to_zero(spark):
    m, log = frames(spark, [("a", 0.0, "dn1"), ("b", 0.0, "dn1")],
                    [("a", 1.0, "READ", "dn1"), ("b", 1.0, "READ", "dn1")])
    for r in compute_features(m, log).features.collect():
        assert r["access_freq_norm"] == 0.0 and r["age_norm"] == 0.0
        assert r["locality_norm"] == 0.0 and r["concurrency_norm"] == 0.0


def test_bucket_width_groups_accesses(spark):
    m, log = frames(spark, [("a", 0.0, "dn1")],
                    [("a", t, "READ", "dn1") for t in (0.1, 0.9, 1.0, 59.0, 61.0)])
    assert by_path(feat.peak_concurrency(log))["a"]["max_concurrency"] == 2
    assert by_path(feat.peak_concurrency(log, 60.0))["a"]["max_concurrency"] == 4


def test_norms_within_unit_interval(spark):
    from tests.conftest import SF_SMALL
    from tierspark.sources.driver_tables import VIEWS
    v = VIEWS["part_lineitem"]
    run = compute_features(v.manifest(spark, SF_SMALL), v.log(spark, SF_SMALL), v.width)
    from tierspark.schemas import NORM_FEATURES
    for r in run.features.collect():
        for c in NORM_FEATURES:
            assert 0.0 <= r[c] <= 1.0


def test_hot_path_with_a_third_of_the_log_matches_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    n = 6000
    paths = np.where(rng.random(n) < 1 / 3, "hot", rng.integers(0, 300, n).astype(str))
    log_pd = pd.DataFrame({
        "path": paths,
        "ts_epoch": np.round(rng.uniform(0, 5000, n), 3),
        "op": rng.choice(["READ", "WRITE", "DELETE"], n),
        "client_node": rng.choice(["dn1", "dn2", "dn3"], n),
    })
    man_pd = pd.DataFrame({"path": ["hot"] + [str(i) for i in range(0, 400)],
                           "creation_epoch": np.arange(401, dtype=float),
                           "primary_node": ["dn1"] + [f"dn{i % 3 + 1}" for i in range(400)]})
    log = spark.createDataFrame(log_pd).repartition(7)
    man = spark.createDataFrame(man_pd)
    width = 60.0
    got = {r["path"]: r for r in compute_features(man, log, width).features.collect()}

    end = log_pd.ts_epoch.max()
    g = log_pd.groupby("path")
    freq = g.size()
    writes = g.apply(lambda d: (d.op == "WRITE").sum(), include_groups=False)
    peak = log_pd.assign(b=np.floor(log_pd.ts_epoch / width)).groupby(["path", "b"]).size() \
        .groupby(level=0).max()
    prim = dict(zip(man_pd.path, man_pd.primary_node))
    local = log_pd[log_pd.client_node == log_pd.path.map(prim)].groupby("path").size()
    mu = sum(int(writes.get(p, 0)) for p in man_pd.path) / len(man_pd)
    for p, c in zip(man_pd.path, man_pd.creation_epoch):
        r = got[p]
        assert r["access_freq"] == int(freq.get(p, 0))
        assert r["concurrency"] == int(peak.get(p, 0))
        assert r["age_seconds"] == end - c
        assert r["write_ratio"] == int(writes.get(p, 0)) / mu
        want_loc = int(local.get(p, 0)) / int(freq[p]) if p in freq else 1.0
        assert r["locality"] == want_loc
    assert got["hot"]["access_freq"] > n / 4


def test_a_path_with_a_million_clients_keeps_only_its_primary_nodes(spark):
    log = spark.range(1_000_000).select(
        F.lit("hot").alias("path"), (F.col("id") % 977).cast("double").alias("ts_epoch"),
        F.lit("READ").alias("op"), F.concat(F.lit("c"), F.col("id")).alias("client_node"))
    m = spark.createDataFrame([("hot", 0.0, "c5"), ("hot", 0.0, "c7"), ("hot", 0.0, "absent")],
                              "path string, creation_epoch double, primary_node string")
    t = feat.path_table(feat.log_counts(log), m)
    row = t.select("access_freq", "max_concurrency", F.size("primaries").alias("kept")).collect()
    assert [tuple(r) for r in row] == [(1_000_000, 1024, 3)]
    local = [r["local_accesses"] for r in feat.file_stats(m, log).collect()]
    assert sorted(x or 0 for x in local) == [0, 1, 1]


def test_only_hot_paths_are_salted(spark):
    rows = [("hot", float(i), "READ", f"c{i % 7}") for i in range(4000)]
    rows += [(f"p{i}", 1.0, "WRITE", "c1") for i in range(3000)] + [(None, 1.0, "READ", "c1")] * 50
    log = spark.createDataFrame(rows, "path string, ts_epoch double, op string, client_node string")
    m = spark.createDataFrame([("hot", "c3")] + [(f"p{i}", "c1") for i in range(3000)],
                              "path string, primary_node string")
    hot = {r["path"]: r["parts"] for r in feat.hot_paths(log, 1 / 100).collect()}
    assert set(hot) == {"hot"} and 50 <= hot["hot"] <= 100
    got = feat.op_flags(log, m, 1 / 100)
    assert got.count() == len(rows)
    want = sum(1 for p, _, _, c in rows if (p == "hot" and c == "c3") or (p or "").startswith("p"))
    assert got.agg(F.sum("is_local")).first()[0] == want
    assert got.where("path IS NULL AND (is_local = 1 OR primary_node IS NOT NULL)").count() == 0
