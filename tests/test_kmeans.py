"""k-means++ and Lloyd: properties and edge rules (K1-K9, E10, E11, P7)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierspark.operators import kmeans as km
from tierspark.plans.classification_job import classify_files
from tierspark.schemas import NORM_FEATURES

COLS = ["x", "y"]


def pts(spark, rows):
    return spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(rows)],
                                 "id string, x double, y double")


def blobs(n=60, seed=3):
    rng = np.random.default_rng(seed)
    centers = [(0, 0), (5, 5), (0, 5)]
    return [tuple(rng.normal(centers[i % 3], 0.3)) for i in range(n)]


def test_seeds_are_distinct_points_with_positive_d2(spark):
    df = pts(spark, blobs())
    seeds = km.kmeanspp_seeds(df, COLS, "id", 3, seed=11)
    ids = [s[0] for s in seeds]
    assert len(set(ids)) == 3
    for i in range(1, 3):
        d2 = sum((a - b) ** 2 for a, b in zip(seeds[i][1], seeds[0][1]))
        assert d2 > 0


def test_seeding_is_independent_of_partitioning(spark):
    df = pts(spark, blobs())
    a = km.kmeanspp_seeds(df.repartition(1), COLS, "id", 3, seed=5)
    b = km.kmeanspp_seeds(df.repartition(7), COLS, "id", 3, seed=5)
    assert [s[0] for s in a] == [s[0] for s in b]


def test_race_picks_follow_d2_weights(spark):
    # three points at D^2 = 1, 4, 9 from the first seed: picks ~ 1/14, 4/14, 9/14
    df = spark.createDataFrame([("s", 0.0, 0.0), ("a", 1.0, 0.0), ("b", 2.0, 0.0), ("c", 3.0, 0.0)],
                               "id string, x double, y double")
    d2 = km.d2_column(COLS, [[0.0, 0.0]])
    counts = {"a": 0, "b": 0, "c": 0}
    keyed = df.where(d2 > 0)
    n = 400
    race = [F.min_by("id", km.race_key(s, 1, "id", d2)).alias(f"p{s}") for s in range(n)]
    row = keyed.agg(*race).collect()[0]
    for s in range(n):
        counts[row[f"p{s}"]] += 1
    expect = {"a": 1 / 14, "b": 4 / 14, "c": 9 / 14}
    for k, p in expect.items():
        assert abs(counts[k] / n - p) < 4 * math.sqrt(p * (1 - p) / n)


def test_fewer_distinct_points_than_k(spark):
    df = pts(spark, [(1, 1)] * 5 + [(2, 2)] * 5)
    with pytest.raises(ValueError, match="distinct"):
        km.kmeanspp_seeds(df, COLS, "id", 3)


def test_fewer_samples_than_k(spark):
    df = pts(spark, [(1, 1), (2, 2)])
    with pytest.raises(ValueError, match="at least as many"):
        km.kmeans(df, COLS, "id", 3)


def test_every_point_in_one_cluster_and_inertia_never_rises(spark):
    df = pts(spark, blobs(90)).cache()
    seeds = [s[1] for s in km.kmeanspp_seeds(df, COLS, "id", 3, seed=2)]
    centers, last = seeds, None
    for _ in range(6):
        lab = km.assign(df, COLS, centers)
        inertia = df.agg(F.sum(km.d2_column(COLS, centers))).collect()[0][0]
        if last is not None:
            assert inertia <= last + 1e-9
        last = inertia
        means, _ = km.update(lab, COLS, 3)
        centers = [m if m is not None else c for m, c in zip(means, centers)]
    labels = lab.select("id", "cluster").collect()
    assert len(labels) == 90 and {r["cluster"] for r in labels} <= {0, 1, 2}


def test_fit_matches_numpy_lloyd_from_same_seeds(spark):
    rows = blobs(60)
    df = pts(spark, rows)
    seeds = [s[1] for s in km.kmeanspp_seeds(df, COLS, "id", 3, seed=9)]
    res = km.kmeans(df, COLS, "id", 3, init=seeds, tol=1e-4)
    X = np.asarray(rows)
    C = np.asarray(seeds)
    for _ in range(100):
        labels = np.argmin(np.linalg.norm(X[:, None, :] - C[None, :, :], axis=2), axis=1)
        new = np.array([X[labels == j].mean(axis=0) for j in range(3)])
        shift = np.linalg.norm(new - C)
        C = new
        if shift < 1e-4:
            break
    np.testing.assert_allclose(np.asarray(res.centroids), C, rtol=0, atol=1e-10)
    assert res.converged
    got = {r["id"]: r["cluster"] for r in res.labeled.collect()}
    assert [got[str(i)] for i in range(60)] == labels.tolist()


def test_labels_are_from_the_last_assignment(spark):
    # one iteration: labels from the seeds, centroids = their means
    df = pts(spark, [(0, 0), (0, 1), (10, 0), (10, 1), (4, 0)])
    res = km.kmeans(df, COLS, "id", 2, init=[[0.0, 0.0], [10.0, 0.0]], max_iter=1)
    got = {r["id"]: r["cluster"] for r in res.labeled.collect()}
    assert got == {"0": 0, "1": 0, "2": 1, "3": 1, "4": 0}
    assert np.allclose(res.centroids, [[4 / 3, 1 / 3], [10.0, 0.5]], atol=1e-11, rtol=0)
    assert not res.converged
    assert res.iterations == 1


def test_empty_cluster_is_reseeded_from_a_data_point(spark):
    df = pts(spark, [(0, 0), (0, 1), (1, 0)])
    res = km.kmeans(df, COLS, "id", 2, init=[[0.0, 0.0], [100.0, 100.0]], max_iter=1)
    assert res.counts[1] == 0
    assert res.centroids[1] in ([0.0, 0.0], [0.0, 1.0], [1.0, 0.0])


def test_default_iteration_cap():
    # max(100, n // 100): an integer also above 10,000 points
    assert max(100, 25_000 // 100) == 250


@pytest.mark.parametrize("n", [5, 500])
@pytest.mark.parametrize("missing", [None, float("nan")])
def test_missing_coordinates_mean_the_same_at_every_size(spark, n, missing):
    df = spark.range(n).selectExpr("CAST(id AS STRING) AS id", "CAST(id AS DOUBLE) AS x",
                                   "CAST(id % 3 AS DOUBLE) AS y")
    df = df.withColumn("y", F.when(F.col("id") == "2", F.lit(missing).cast("double"))
                       .otherwise(F.col("y")))
    lab = {r["id"]: r["cluster"] for r in km.assign(df, COLS, [[0.0, 0.0], [1.0, 1.0]]).collect()}
    assert lab["2"] is None and sum(v is None for v in lab.values()) == 1
    _, counts = km.update(km.assign(df, COLS, [[0.0, 0.0], [1.0, 1.0]]), COLS, 2)
    assert sum(counts) == n - 1
    with pytest.raises(ValueError, match="NULL or NaN"):
        km.kmeans(df, COLS, "id", 2)
    assert "2" not in [s[0] for s in km.kmeanspp_seeds(df, COLS, "id", 3)]


def test_infinite_coordinates_are_refused(spark):
    with pytest.raises(ValueError, match="infinite"):
        km.kmeans(pts(spark, [(1.0, 2.0), (float("inf"), 1.0), (3.0, 4.0)]), COLS, "id", 2)


@pytest.mark.parametrize("scale", [1e9, 1e300, 1e-30, 1e-305])
def test_means_at_any_scale_are_exact_to_a_double(spark, scale):
    from fractions import Fraction
    rng = np.random.default_rng(5)
    rows = [(float(x) * scale, float(x) * scale * 1e-7) for x in rng.normal(0.3, 1.0, 500)]
    df = pts(spark, rows).withColumn("cluster", F.lit(0))
    first = None
    for n in (1, 3, 7, 16, 200):
        means, counts = km.update(df.repartition(n), COLS, 1)
        first = first or means
        assert means == first and counts == [500]
    for c in range(2):
        exact = float(sum(Fraction(r[c]) for r in rows) / len(rows))
        top = max(abs(r[c]) for r in rows)
        assert abs(means[0][c] - exact) <= 2.0 ** -52 * abs(exact) + max(2.0 ** -60 * top, 5e-324)


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e-305])
def test_the_step_in_one_pass_equals_assignment_and_update(spark, scale):
    rng = np.random.default_rng(12)
    rows = [(float(a) * scale, round(float(b)) * scale) for a, b in rng.normal(0, 3, (900, 2))]
    df = pts(spark, rows + rows[:40])                                 # repeated points, ties
    centers = [[0.0, 0.0], [scale, scale], [scale, -scale], [0.0, 0.0], [500 * scale, 500 * scale]]
    units = km.column_units(df, COLS)[1]
    want = km.update(km.assign(df, COLS, centers), COLS, 5, units=units)
    for n in (1, 7, 60):
        assert km.lloyd_step(df.repartition(n), COLS, centers, units) == want
    assert want[0][3] is None and want[0][4] is None                  # a tie's higher index; too far


def test_raw_fit_is_the_same_for_every_partitioning(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a) * 1e9, float(b)) for a, b in zip(rng.uniform(-1, 1, 700), rng.exponential(40, 700))]
    df, seen = pts(spark, rows), []
    for n in (1, 3, 7, 16, 200):
        r = km.kmeans(df.repartition(n), COLS, "id", 4, seed=3, max_iter=6)
        seen.append((r.centroids, r.counts, r.iterations, r.shifts))
    assert all(x == seen[0] for x in seen)


def test_written_d2_gives_the_same_seeds(spark):
    df = pts(spark, blobs(80))
    whole = km.kmeanspp_seeds(df, COLS, "id", 12, seed=4, block=100)
    assert km.kmeanspp_seeds(df, COLS, "id", 12, seed=4, block=1) == whole
    assert km.kmeanspp_seeds(df, COLS, "id", 12, seed=4, block=5) == whole


def test_a_round_of_the_seeding_computes_a_bounded_number_of_distances(spark, monkeypatch):
    asked = []
    real = km.d2_column
    monkeypatch.setattr(km, "d2_column", lambda cols, centers: asked.append(len(centers)) or real(cols, centers))
    km.kmeanspp_seeds(pts(spark, blobs(90)), COLS, "id", 14, seed=4, block=4)
    assert len(asked) == 13 and max(asked) == 4


def test_three_empty_clusters_are_reseeded_in_one_aggregate(spark, monkeypatch):
    df, calls = pts(spark, blobs()), []
    real = km._pick_each
    monkeypatch.setattr(km, "_pick_each", lambda *a: calls.append(len(a[3])) or real(*a))
    far = [[100.0 + j, 100.0] for j in range(3)]
    r = km.kmeans(df, COLS, "id", 5, max_iter=1, init=[[0.0, 0.0], [5.0, 5.0]] + far)
    assert calls == [3] and r.counts[2:] == [0, 0, 0]
    own = {tuple(x) for x in df.select(*COLS).collect()}
    assert len({tuple(c) for c in r.centroids[2:]} & own) == 3


def test_a_fit_goes_on_from_its_written_state(spark, tmp_path, monkeypatch):
    df, where = pts(spark, blobs(200, 8)).persist(), f"{tmp_path}/fit"
    start = [[0.0, 0.0], [0.1, 0.0], [0.0, 0.1], [0.1, 0.1]]
    whole = km.kmeans(df, COLS, "id", 4, seed=6, tol=1e-9, init=start)
    assert whole.iterations > 3
    km.kmeans(df, COLS, "id", 4, seed=6, tol=1e-9, init=start, max_iter=3, state_path=where)
    (tmp_path / "fit" / "iteration-000009").mkdir()      # begun, never marked complete
    monkeypatch.setattr(km, "kmeanspp_seeds", lambda *a: pytest.fail("seeded anew"))
    rest = km.kmeans(df, COLS, "id", 4, seed=6, tol=1e-9, state_path=where)
    assert (rest.iterations, rest.centroids, rest.shifts, rest.init) == (
        whole.iterations, whole.centroids, whole.shifts, whole.init)
    assert sorted(rest.labeled.collect()) == sorted(whole.labeled.collect())
    again = km.kmeans(df, COLS, "id", 4, seed=6, tol=1e-9, state_path=where)   # nothing left to do
    assert again.iterations == whole.iterations
    assert sorted(again.labeled.collect()) == sorted(whole.labeled.collect())
    with pytest.raises(ValueError, match="another fit"):
        km.kmeans(df, COLS, "id", 4, seed=7, tol=1e-9, state_path=where)


def test_fit_is_the_same_for_every_partitioning(spark):
    from tests.conftest import SF_ORACLE
    from tierspark.plans.feature_job import compute_features
    from tierspark.session import materialize
    from tierspark.sources.driver_tables import VIEWS
    v = VIEWS["customer_events"]
    run = compute_features(v.manifest(spark, SF_ORACLE), v.log(spark, SF_ORACLE), v.width)
    feats = materialize(run.features.select("path", *NORM_FEATURES), "points")
    fits = []
    for n in (1, 3, 7, 16, 200):
        res = km.kmeans(feats.repartition(n).cache(), NORM_FEATURES, "path", 4, seed=42)
        labels = {r["path"]: r["cluster"] for r in res.labeled.collect()}
        fits.append((res.iterations, res.centroids, labels))
    assert all(f == fits[0] for f in fits[1:])


def test_classify_files_covers_every_file(spark):
    from tests.conftest import SF_SMALL
    from tierspark.plans.feature_job import compute_features
    from tierspark.sources.driver_tables import VIEWS
    v = VIEWS["customer_events"]
    run = compute_features(v.manifest(spark, SF_SMALL), v.log(spark, SF_SMALL), v.width)
    res = classify_files(run.features, 4, seed=42)
    files = res.files.collect()
    assert len(files) == run.n_files == len({r["path"] for r in files})
    table = res.table.collect()
    assert len(table) == 4
    for r in table:
        assert r["centroid_id"].startswith("CENTROID_")
        assert len(r["centroid_id"].split("_")) == 6
        assert r["category"] in ("Hot", "Shared", "Moderate", "Archival")
    again = classify_files(run.features.repartition(3), 4, seed=42).table.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, table))


def test_mllib_alternative_runs(spark):
    df = pts(spark, blobs(30))
    centers, labeled = km.mllib_kmeans(df, COLS, 3, seed=1)
    assert len(centers) == 3 and labeled.count() == 30


def test_nearest_centre_and_tie_for_many_terms(spark):
    rng = np.random.default_rng(1)
    cols = [f"c{i}" for i in range(8)]
    x = rng.normal(size=(50, 8))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x],
                               ", ".join(f"{c} double" for c in cols))
    centers = [list(map(float, r)) for r in rng.normal(size=(40, 8))]   # 320 terms
    centers[7] = centers[3]                                               # a tie
    got = [r["cluster"] for r in km.assign(df, cols, centers).collect()]
    want = ((x[:, None, :] - np.array(centers)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert got == want.tolist() and 7 not in got


def test_mllib_method_in_classification(spark):
    feats = spark.createDataFrame(
        [(str(i), *[float((i * (j + 3)) % 17) / 16 for j in range(5)]) for i in range(40)],
        "path string, " + ", ".join(f"{c} double" for c in NORM_FEATURES))
    res = classify_files(feats, 3, method="mllib", seed=1)
    assert res.table.count() == 3 and res.files.count() == 40


def test_data_medians_option(spark):
    from tests.conftest import SF_SMALL
    from tierspark.operators.scoring import global_medians
    from tierspark.plans.feature_job import compute_features
    from tierspark.sources.driver_tables import VIEWS
    v = VIEWS["part_lineitem"]
    run = compute_features(v.manifest(spark, SF_SMALL), v.log(spark, SF_SMALL), v.width)
    res = classify_files(run.features, 4, seed=42, medians_from="data")
    gm = global_medians(run.features, NORM_FEATURES)
    pdf = run.features.select(*NORM_FEATURES).toPandas()
    assert gm == {c: float(np.median(pdf[c])) for c in NORM_FEATURES}
    assert {r["category"] for r in res.table.collect()} <= {"Hot", "Shared", "Moderate", "Archival"}
