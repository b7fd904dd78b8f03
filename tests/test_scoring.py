"""Scoring rules: the scorer demo (golden values derived by hand) and edges."""

import pytest

from tierspark.operators.median import exact_medians
from tierspark.operators.scoring import category_scores, classify
from tierspark.schemas import DEFAULT_RULES, NORM_FEATURES, Rules

# Fixed values (the scorer demo as listed in FIXTURES.md section 5): four clusters, two
# features, and their rules.
DEMO = {
    0: {"IOPS": [100, 110, 105], "Latency": [2, 3, 2.5]},
    1: {"IOPS": [50, 55, 60], "Latency": [5, 6, 5.5]},
    2: {"IOPS": [10, 12, 11], "Latency": [8, 9, 7]},
    3: {"IOPS": [200, 210, 220], "Latency": [1, 1.5, 1.2]},
}
DEMO_RULES = Rules(
    features=("IOPS", "Latency"),
    global_medians={"IOPS": 60.0, "Latency": 4.0},
    weights={"Hot": {"IOPS": 1.0, "Latency": 0.8}, "Shared": {"IOPS": 0.7, "Latency": 0.7},
             "Moderate": {"IOPS": 0.5, "Latency": 0.5}, "Archival": {"IOPS": 0.9, "Latency": 1.0}},
    directions={"Hot": {"IOPS": 1, "Latency": -1}, "Shared": {"IOPS": 1, "Latency": 1},
                "Moderate": {"IOPS": 0, "Latency": 0}, "Archival": {"IOPS": -1, "Latency": 1}},
    replication_factors={"Hot": 3, "Shared": 2, "Moderate": 1, "Archival": 4},
    categories=("Hot", "Shared", "Moderate", "Archival"),
).validate()

GOLDEN = {
    0: ({"Hot": 2026.8, "Shared": 1417.5, "Moderate": 0.0, "Archival": 0.0}, "Hot"),
    1: ({"Hot": 0.0, "Shared": 1.575, "Moderate": 0.0, "Archival": 24.75}, "Archival"),
    2: ({"Hot": 0.0, "Shared": 11.2, "Moderate": 0.0, "Archival": 2176.9}, "Archival"),
    3: ({"Hot": 22506.272, "Shared": 15750.0, "Moderate": 0.0, "Archival": 0.0}, "Hot"),
}


def test_scorer_demo(spark):
    rows = [(c, float(i), float(l)) for c, f in DEMO.items() for i, l in zip(f["IOPS"], f["Latency"])]
    df = spark.createDataFrame(rows, "cluster int, IOPS double, Latency double")
    meds = exact_medians(df, ["cluster"], ["IOPS", "Latency"])
    scores = category_scores(meds, DEMO_RULES).collect()
    for r in scores:
        assert r["score"] == pytest.approx(GOLDEN[r["cluster"]][0][r["category"]], rel=1e-12)
    cats = {r["cluster"]: r["category"] for r in classify(meds, DEMO_RULES).collect()}
    assert cats == {c: g[1] for c, g in GOLDEN.items()}


def _meds(spark, rows):
    return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{c} double" for c in NORM_FEATURES))


def test_empty_cluster_scores_zero_and_ties_to_highest_rf(spark):
    meds = _meds(spark, [(0, None, None, None, None, None)])
    scores = category_scores(meds).collect()
    assert all(r["score"] == 0.0 for r in scores)
    assert classify(meds).collect()[0]["category"] == "Archival"


def test_zero_delta_scores_only_moderate(spark):
    meds = _meds(spark, [(0, 0.5, 0.5, 0.5, 0.5, 0.5)])
    s = {r["category"]: r["score"] for r in category_scores(meds).collect()}
    assert s["Hot"] == s["Shared"] == s["Archival"] == 0.0
    assert s["Moderate"] == pytest.approx(2.5)
    assert classify(meds).collect()[0]["category"] == "Moderate"


def test_moderate_band_is_strict(spark):
    # with global median 0, a median of 0.1 is a delta of exactly 0.1: outside the band
    rules = Rules(DEFAULT_RULES.features, {f: 0.0 for f in NORM_FEATURES}, DEFAULT_RULES.weights,
                  DEFAULT_RULES.directions, DEFAULT_RULES.replication_factors,
                  DEFAULT_RULES.categories)
    meds = _meds(spark, [(0, 0.1, 0.1, 0.1, 0.1, 0.1), (1, 0.09, 0.09, 0.09, 0.09, 0.09)])
    s = {(r["cluster"], r["category"]): r["score"] for r in category_scores(meds, rules).collect()}
    assert s[(0, "Moderate")] == 0.0
    assert s[(1, "Moderate")] == pytest.approx(5 * 0.5 * 0.91 ** 2)


def test_tie_on_score_prefers_replication_factor_then_order(spark):
    rules = Rules(("x",), {"x": 0.0}, {c: {"x": 1.0} for c in ("A", "B", "C")},
                  {"A": {"x": 1}, "B": {"x": 1}, "C": {"x": 1}}, {"A": 1, "B": 2, "C": 2},
                  ("A", "B", "C"))
    meds = spark.createDataFrame([(0, 2.0)], "cluster int, x double")
    assert classify(meds, rules).collect()[0]["category"] == "B"


def test_default_rules_are_the_fixed_values():
    r = DEFAULT_RULES
    assert r.categories == ("Hot", "Shared", "Moderate", "Archival")
    assert [r.weights["Hot"][f] for f in NORM_FEATURES] == [1.0, 0.8, 0.5, 0.5, 1.0]
    assert [r.directions["Archival"][f] for f in NORM_FEATURES] == [-1, 1, -1, -1, -1]
    assert r.replication_factors == {"Hot": 3, "Shared": 2, "Moderate": 1, "Archival": 4}


def test_cluster_names(spark):
    from pyspark.sql import functions as F
    from tierspark.functions.formatting import cluster_name
    df = spark.range(3).select(cluster_name(F.col("id")).alias("name"))
    assert [r["name"] for r in df.collect()] == ["C0", "C1", "C2"]


def test_replaceable_deviation_weight(spark):
    def cube(x):
        return x * x * x
    meds = _meds(spark, [(0, 0.9, 0.1, 0.9, 0.9, 0.9)])
    got = {r["category"]: r["score"] for r in category_scores(meds, f=cube).collect()}
    w = DEFAULT_RULES.weights["Hot"]
    d = [0.4, -0.4, 0.4, 0.4, 0.4]
    want = 0.0
    for f_, dv in zip(NORM_FEATURES, d):
        want += w[f_] * abs(dv) ** 3
    assert got["Hot"] == pytest.approx(want, rel=1e-12)
    assert got["Moderate"] == 0.0


def test_rules_json_round_trip():
    import json
    d = json.loads(json.dumps(DEFAULT_RULES.to_dict()))
    assert Rules.from_dict(d) == DEFAULT_RULES
    changed = Rules.from_dict({"global_medians": {f: 0.25 for f in NORM_FEATURES}})
    assert changed.global_medians["age_norm"] == 0.25 and changed.weights == DEFAULT_RULES.weights
    with pytest.raises(ValueError):
        Rules.from_dict({"replication_factors": {"Hot": 3}})
