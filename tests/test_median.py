"""Exact distributed medians against NumPy, including refinement passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierspark.operators.median import exact_medians


def _np_median(values):
    return float(np.median(np.asarray(values, dtype=float))) if len(values) else None


@pytest.mark.parametrize("window_rows", [2000, 7, 2])
def test_matches_numpy(spark, window_rows):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(4):
        n = [1, 2, 57, 200][g]
        vals = rng.exponential(1.0 + g, n) * (1 if g % 2 else -1)
        vals[: n // 3] = np.round(vals[: n // 3], 1)          # ties
        rows += [(g, float(v), float(v) * 3.0 + 1) for v in vals]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(5)
    got = {r["g"]: r for r in exact_medians(df, ["g"], ["a", "b"],
                                            window_rows=window_rows).collect()}
    for g in range(4):
        a = [r[1] for r in rows if r[0] == g]
        b = [r[2] for r in rows if r[0] == g]
        assert got[g]["a"] == pytest.approx(_np_median(a), rel=0, abs=0)
        assert got[g]["b"] == pytest.approx(_np_median(b), rel=0, abs=0)


def test_even_count_is_mean_of_middle_two(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 10.0), (1, 20.0)], "g int, v double")
    assert exact_medians(df, ["g"], ["v"], window_rows=1).collect()[0]["v"] == 6.0


def test_constant_and_global(spark):
    df = spark.createDataFrame([(0, 0.5)] * 9 + [(0, 0.25)], "g int, v double")
    assert exact_medians(df, [], ["v"], window_rows=2).collect()[0]["v"] == 0.5
    assert exact_medians(df, ["g"], ["v"]).collect()[0]["v"] == 0.5


def test_null_values_are_ignored(spark):
    df = spark.createDataFrame([(0, None), (0, 3.0), (0, 1.0), (1, None)], "g int, v double")
    got = {r["g"]: r["v"] for r in exact_medians(df, ["g"], ["v"]).collect()}
    assert got[0] == 2.0 and got.get(1) is None


def test_heavy_tails_and_many_rounds(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([10.0 ** rng.uniform(-300, 300, 4001), [0.0] * 500, -rng.exponential(1, 700)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(6)
    assert exact_medians(df, [], ["v"], window_rows=1).collect()[0]["v"] == float(np.median(v))


def test_more_than_a_hundred_thousand_groups_and_columns(spark):
    n = 60_000
    df = spark.range(3 * n).selectExpr(
        f"CASE WHEN id % {n} = 5 THEN NULL ELSE id % {n} END AS g",
        f"CAST(id div {n} AS DOUBLE) AS v", f"CAST((id div {n}) * (id % {n} % 7) AS DOUBLE) AS w")
    got = exact_medians(df, ["g"], ["v", "w"], window_rows=2).selectExpr(
        "count(1) AS n", "sum(v) AS v", f"sum(abs(w - coalesce(g, 5) % 7)) AS off").first()
    assert tuple(got) == (n, float(n), 0.0)


def test_nothing_is_collected_but_the_number_of_open_groups(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v")
    kind = type(df)
    monkeypatch.setattr(kind, "collect", lambda self: pytest.fail("collect"))
    monkeypatch.setattr(kind, "toPandas", lambda self: pytest.fail("toPandas"))
    assert exact_medians(df, ["g"], ["v"], window_rows=10).count() == 3


def test_no_rows(spark):
    df = spark.createDataFrame([], "g int, v double")
    assert exact_medians(df, ["g"], ["v"]).collect() == []
    assert exact_medians(df, [], ["v"]).collect()[0]["v"] is None


def test_property_random_groups(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 2), st.floats(-1e6, 1e6, allow_nan=False)),
                    min_size=1, max_size=40))
    def check(rows):
        df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g int, v double")
        got = {r["g"]: r["v"] for r in exact_medians(df, ["g"], ["v"], window_rows=3).collect()}
        for g in {g for g, _ in rows}:
            assert got[g] == _np_median([v for h, v in rows if h == g])

    check()


def test_many_groups(spark):
    rng = np.random.default_rng(11)
    rows = [(int(g), float(v)) for g in range(30) for v in rng.normal(g, 1.0, 25)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["v"] for r in exact_medians(df, ["g"], ["v"], window_rows=5).collect()}
    for g in range(30):
        assert got[g] == _np_median([v for h, v in rows if h == g])


def _written(monkeypatch):
    """(label, rows, rows by range) of each table that the medians write."""
    from tierspark.operators import median
    seen, write = [], median.materialize

    def counted(df, label):
        out = write(df, label)
        by = sorted(n for p, n in out.groupBy("pid").count().toLocalIterator() if p is not None) \
            if "pid" in out.columns else None
        seen.append((label, out.count(), by))
        return out

    monkeypatch.setattr(median, "materialize", counted)
    return seen


def test_many_groups_above_the_window_are_settled_in_one_move(spark, monkeypatch):
    seen = _written(monkeypatch)
    df = spark.range(60_000).selectExpr("concat('p', id % 2000) AS g", "CAST(id * 7919 % 60000 AS DOUBLE) AS v")
    got = {r["g"]: r["v"] for r in exact_medians(df, ["g"], ["v"], window_rows=24).collect()}
    want = {f"p{g}": _np_median([i * 7919 % 60000 for i in range(g, 60_000, 2000)]) for g in range(2000)}
    assert got == want
    assert [x[0] for x in seen] == ["median-runs", "medians"]
    assert seen[0][1] < 2000 + 60 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_one_group_of_equal_values_is_dealt_over_ranges(spark, monkeypatch):
    seen = _written(monkeypatch)
    df = spark.range(0, 40_000, 1, 16).selectExpr("'only' AS g", "1.5D AS v", "CAST(id AS DOUBLE) AS w")
    assert exact_medians(df, ["g"], ["v", "w"], window_rows=100).first()[1:] == (1.5, 19_999.5)
    label, n, by = seen[0]
    assert (label, n) == ("median-runs", 80_000) and len(by) > 2 and max(by) < 50_000


@pytest.mark.parametrize("window_rows", [1, 3, 50])
def test_group_columns_of_any_type_null_and_nan(spark, window_rows):
    kinds = ["struct(id % 3 AS a)", "array(id % 3, NULL)", "IF(id % 3 = 0, NULL, id % 3)",
             "CASE id % 3 WHEN 0 THEN DOUBLE('NaN') WHEN 1 THEN NULL ELSE IF(id % 2 = 0, -0.0D, 0.0D) END",
             "IF(id % 3 = 0, NULL, concat('x', id % 3))", "id % 3 = 0"]
    base = spark.range(60)
    for kind in kinds:
        df = base.selectExpr(f"{kind} AS v", "CAST(id * 17 % 60 AS DOUBLE) AS feature",
                             "IF(id % 5 = 0, NULL, CAST(id AS DOUBLE)) AS key_0").repartition(3)
        got = exact_medians(df, ["v"], ["feature", "key_0"], window_rows=window_rows)
        want = df.groupBy("v").agg(F.median("feature").alias("feature"),
                                   F.median("key_0").alias("key_0"))
        assert got.columns == ["v", "feature", "key_0"]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), kind
