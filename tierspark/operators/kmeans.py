"""k-means++ seeding and Lloyd iterations as DataFrame jobs.

* Points are rows with ``d`` double columns and a unique id column.
* Centres are at most ``k x d`` numbers kept on the driver: no points x centres join.
  An iteration (:func:`lloyd_step`) is one pass over Arrow batches, which labels points
  and sums them per cluster (``k`` rows per task before the final merge), and only
  ``k x d`` numbers come back. Labels are a projection with the centres as literals
  (:func:`assign`). Plans therefore stay the same size across iterations.
* Means are sums of whole multiples of a unit, 62 bits below the largest magnitude
  of their column, kept in three longs: whatever the scale of a column, they do not
  depend on the order of addition, so any partitioning gives the same labels,
  centres and number of iterations, bit by bit (:func:`column_units`).
* A point with a NULL or NaN coordinate has no label and is never a seed;
  :func:`kmeans` refuses such input, and infinite coordinates (:func:`check_points`).
* k-means++ draws the next seed with probability D^2 / sum(D^2) as an
  exponential race: ``argmin(-ln(u) / D^2)`` over rows with ``D^2 > 0``, where
  ``u`` is a per-row uniform hashed from (seed, round, id). That is exact D^2
  sampling in one aggregate pass, needs no cumulative sum, and gives the same
  draw for any partitioning. D^2 to earlier seeds is a written column, so a round
  computes a bounded number of distances and k seeds cost k times one.
* A fit can keep its state in a shared folder and go on from it after the driver
  is lost (``state_path``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from tierspark.functions.hashing import uniform01
from tierspark.functions.vectors import complete_sql, min_sq_dist, nearest_index, qcol
from tierspark.session import complete_folders, materialize, release


@dataclass
class KMeansResult:
    centroids: list                # k x d, means of the last assignment
    labeled: DataFrame             # points + cluster id of the last assignment
    iterations: int
    shifts: list = field(default_factory=list)
    init: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    cols: tuple = ()
    converged: bool = False        # the shift fell below tol (not ended by max_iter)


#: Name of the written D^2 column of the seeding.
RUNNING = "_running_d2"


def _pick_each(df: DataFrame, cols: Sequence[str], id_col: str, keys) -> list:
    """For each key the row where it is smallest, ``(id, [values...])`` or None: all in
    one aggregate."""
    row = F.expr("struct(" + ", ".join([f"{qcol(id_col)} AS id"] + [qcol(c) for c in cols]) + ")")
    best = df.agg(*[F.min_by(row, key).alias(f"b{i}") for i, key in enumerate(keys)]).collect()[0]
    return [None if b is None else (b[0], [float(x) for x in b[1:]]) for b in best]


def _pick(df: DataFrame, cols: Sequence[str], id_col: str, key) -> tuple | None:
    return _pick_each(df, cols, id_col, [key])[0]


def d2_column(cols: Sequence[str], centers: Sequence[Sequence[float]]):
    """D^2: squared distance to the nearest of ``centers``."""
    return min_sq_dist(cols, centers)


def race_key(seed: int, round_no: int, id_col: str, d2):
    """Exponential-race key; the smallest key over rows wins with probability
    proportional to ``d2``."""
    return -F.log(uniform01(seed, round_no, id_col)) / d2


def kmeanspp_seeds(points: DataFrame, cols: Sequence[str], id_col: str, k: int,
                   seed: int = 42, block: int = 8) -> list:
    """k-means++ seeding: ``[(id, [values...]), ...]`` of length ``k``.

    Round 0 picks a uniform row (smallest hashed uniform); round i picks by the
    race over D^2 to the seeds chosen so far, one aggregate pass per round. After
    every ``block`` seeds D^2 is written beside the points, and later rounds compute
    distances to younger seeds only; the draw is the same for any ``block``.
    Raises ``ValueError`` when fewer than ``k`` distinct points exist (all
    remaining D^2 are 0).
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    points = points.where(complete_sql(cols)).select(id_col, *cols)
    first = _pick(points, cols, id_col, uniform01(seed, 0, id_col))
    if first is None:
        raise ValueError("no points to seed from")
    seeds, written, table = [first], 0, None
    for i in range(1, k):
        d2 = d2_column(cols, [s[1] for s in seeds[written:]])
        if written:
            d2 = F.least(F.col(RUNNING), d2)
        if len(seeds) - written == block:
            after = materialize(points.select(id_col, *cols, d2.alias(RUNNING)), "running-d2")
            release(table)
            points, table, written, d2 = after, after, len(seeds), F.col(RUNNING)
        nxt = _pick(points.where(d2 > F.lit(0.0)), cols, id_col, race_key(seed, i, id_col, d2))
        if nxt is None:
            raise ValueError(f"fewer than k={k} distinct points: cannot choose seed {i}")
        seeds.append(nxt)
    release(table)
    return seeds


def assign(points: DataFrame, cols: Sequence[str], centers: Sequence[Sequence[float]],
           out: str = "cluster") -> DataFrame:
    """Nearest-centre label (lowest index wins a tie), as a projection; NULL for a
    point with a missing coordinate."""
    return points.withColumn(out, nearest_index(cols, centers))


#: Bits of a coordinate that enter a mean, and of each of the three parts of a sum.
UNIT_BITS, PART_BITS = 62, 21


def column_units(points: DataFrame, cols: Sequence[str]) -> tuple:
    """``(n, units)``: the number of points, and for each column the exponent of its unit,
    2^exponent, which follows from the column's largest magnitude alone. Coordinates are
    cut off to whole units; a double has 53 bits, so those within 2^-9 of the largest
    enter exactly. ``ValueError`` for a missing or infinite coordinate."""
    n, bad, *top = points.selectExpr(
        "count(1)", f"count(CASE WHEN NOT ({complete_sql(cols)}) THEN 1 END)",
        *[f"max(abs({qcol(c)}))" for c in cols]).collect()[0]
    if bad:
        raise ValueError(f"{bad} of {n} points have a NULL or NaN coordinate")
    if any(t is not None and math.isinf(t) for t in top):
        raise ValueError("a coordinate is infinite")
    if n >= 2 ** (63 - PART_BITS):
        raise ValueError(f"{n} points are more than the sums hold")
    return n, [math.frexp(t or 0.5)[1] - UNIT_BITS for t in top]


def check_points(points: DataFrame, cols: Sequence[str]) -> int:
    """Number of points; ``ValueError`` for a missing or infinite coordinate."""
    return column_units(points, cols)[0]


def _scaled(value: str, exponent: int) -> str:
    """SQL for ``value * 2^exponent``; in two steps where 2^exponent is no normal double."""
    steps = [exponent] if abs(exponent) <= 1000 else [exponent // 2, exponent - exponent // 2]
    return " * ".join([value] + [f"{math.ldexp(1.0, e)!r}D" for e in steps])


def _part_sums(c: str, unit: int) -> list:
    """SQL sums of the three parts of a column's whole units, highest first."""
    units, mask = f"floor({_scaled(qcol(c), -unit)})", 2 ** PART_BITS - 1
    return [f"sum(shiftright({units}, {2 * PART_BITS}))",
            f"sum(shiftright({units}, {PART_BITS}) & {mask}L)", f"sum({units} & {mask}L)"]


def _filled_clusters(labeled: DataFrame, cols: Sequence[str], cluster_col: str,
                     units: Sequence[int]) -> DataFrame:
    """One row per cluster that has points: ``n`` and the mean of each column. A partial
    aggregate sends at most ``k`` rows per task."""
    cl = qcol(cluster_col)
    sums = [F.expr(part).alias(f"part_{i}_{p}") for i, (c, u) in enumerate(zip(cols, units))
            for p, part in enumerate(_part_sums(c, u))]
    sums = labeled.where(f"{cl} IS NOT NULL").groupBy(F.expr(f"CAST({cl} AS INT)").alias(
        cluster_col)).agg(F.count(F.lit(1)).alias("n"), *sums)
    means = []
    for i, (c, u) in enumerate(zip(cols, units)):
        a, b, low = (f"CAST(part_{i}_{p} AS DOUBLE)" for p in range(3))
        total = f"({a} * {2.0 ** (2 * PART_BITS)!r}D + {b} * {2.0 ** PART_BITS!r}D + {low})"
        means.append(f"{_scaled(f'{total} / n', u)} AS {qcol(c)}")
    return sums.selectExpr(cl, "n", *means)


def cluster_stats(labeled: DataFrame, cols: Sequence[str], k: int,
                  cluster_col: str = "cluster", units: Sequence[int] | None = None) -> DataFrame:
    """One row per cluster 0..k-1: ``n`` and the mean of each column (NULL for an empty
    cluster). ``units``: of :func:`column_units`, by default taken from the labelled points."""
    if units is None:
        units = column_units(labeled.where(f"{qcol(cluster_col)} IS NOT NULL"), cols)[1]
    ids = labeled.sparkSession.range(k).select(F.col("id").cast("int").alias(cluster_col))
    filled = _filled_clusters(labeled, cols, cluster_col, units)
    return ids.join(filled, cluster_col, "left").na.fill({"n": 0})


def update(labeled: DataFrame, cols: Sequence[str], k: int, cluster_col: str = "cluster",
           units: Sequence[int] | None = None):
    """Means and counts per cluster, collected: ``(means: list|None per j, counts)``."""
    if units is None:
        units = column_units(labeled.where(f"{qcol(cluster_col)} IS NOT NULL"), cols)[1]
    means, counts = [None] * k, [0] * k
    for r in _filled_clusters(labeled, cols, cluster_col, units).collect():
        counts[r[cluster_col]] = r["n"]
        means[r[cluster_col]] = [r[c] for c in cols]
    return means, counts


def _mean_of(parts: Sequence[int], n: int, unit: int) -> float:
    """A mean from the three sums of a column's units, as the SQL of the update has it."""
    high, mid, low = map(float, parts)
    mean = (high * 2.0 ** (2 * PART_BITS) + mid * 2.0 ** PART_BITS + low) / n
    for e in ([unit] if abs(unit) <= 1000 else [unit // 2, unit - unit // 2]):
        mean *= math.ldexp(1.0, e)
    return mean


def lloyd_step(points: DataFrame, cols: Sequence[str], centers: Sequence[Sequence[float]],
               units: Sequence[int]):
    """Assignment and update in one pass: ``(means: list|None per j, counts)``, the same
    bit by bit as :func:`update` of :func:`assign`.

    Each task takes its points in Arrow batches, a column at a time: squared distances are
    added in the order of the columns, and the units of each cluster summed, so it sends at
    most ``k`` rows. Coordinates must be complete."""
    k, d = len(centers), len(cols)
    at = [list(map(float, c)) for c in centers]
    names = ["cluster", "n"] + [f"part_{i}_{p}" for i in range(d) for p in range(3)]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros((k, 1 + 3 * d), np.int64)
        mask = 2 ** PART_BITS - 1
        for batch in batches:
            x = [batch.column(i).to_numpy() for i in range(d)]
            nearest, label = None, np.zeros(batch.num_rows, np.int64)
            with np.errstate(over="ignore"):
                for j in range(k):
                    dist = np.square(x[0] - at[j][0])
                    for i in range(1, d):
                        dist += np.square(x[i] - at[j][i])
                    if nearest is None:
                        nearest = dist
                    else:
                        closer = dist < nearest
                        label[closer] = j
                        nearest = np.minimum(nearest, dist)
            count = np.bincount(label, minlength=k)
            total[:, 0] += count
            order, filled = np.argsort(label, kind="stable"), np.flatnonzero(count)
            firsts = (np.cumsum(count) - count)[filled]
            if not len(filled):
                continue
            for i in range(d):
                u = x[i][order]
                for e in ([-units[i]] if abs(units[i]) <= 1000
                          else [-units[i] // 2, -units[i] - -units[i] // 2]):
                    u = u * math.ldexp(1.0, e)
                u = np.floor(u).astype(np.int64)
                for p, part in enumerate((u >> 2 * PART_BITS, u >> PART_BITS & mask, u & mask)):
                    total[filled, 1 + 3 * i + p] += np.add.reduceat(part, firsts)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype("int32"))] + [pa.array(c) for c in total[some].T.copy()], names)

    schema = "cluster int, " + ", ".join(f"{n} long" for n in names[1:])
    x = points.select(*[F.col(qcol(c)).cast("double").alias(c) for c in cols])
    sums = x.mapInArrow(run, schema).groupBy("cluster").agg(
        *[F.sum(n).alias(n) for n in names[1:]]).collect()
    means, counts = [None] * k, [0] * k
    for r in sums:
        j, n = r["cluster"], r["n"]
        counts[j] = n
        means[j] = [_mean_of([r[f"part_{i}_{p}"] for p in range(3)], n, units[i]) for i in range(d)]
    return means, counts


def frobenius_shift(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> float:
    return math.sqrt(sum((x - y) ** 2 for ra, rb in zip(a, b) for x, y in zip(ra, rb)))


_STATE = ("iteration int, cluster int, centre array<double>, previous array<double>, "
          "start array<double>, n long, shifts array<double>, points long, seed long, tol double")


def save_state(spark, path: str, iteration: int, centers, previous, start, counts, shifts,
               n_points: int, seed: int, tol: float) -> None:
    """The k centres after an iteration, in a folder of their own under ``path``. It counts
    once its writer has marked it complete."""
    rows = [(iteration, j, list(map(float, centers[j])), list(map(float, previous[j])),
             list(map(float, start[j])), int(counts[j]), list(map(float, shifts)), n_points, seed,
             float(tol)) for j in range(len(centers))]
    spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/iteration-{iteration:06d}")


def load_state(spark, path: str) -> list | None:
    """Rows of the last complete iteration under ``path``, by cluster; None if there is none."""
    done = complete_folders(spark, path)
    if not done:
        return None
    return spark.read.schema(_STATE).parquet(done[-1]).orderBy("cluster").collect()


def kmeans(points: DataFrame, cols: Sequence[str], id_col: str, k: int,
           max_iter: int | None = None, tol: float = 1e-4, seed: int = 42,
           init: Sequence[Sequence[float]] | None = None,
           cluster_col: str = "cluster", state_path: str | None = None) -> KMeansResult:
    """Lloyd's algorithm from k-means++ seeds, on columns of any finite scale.

    Stops when the Frobenius norm of the whole centre shift is below ``tol``
    (``converged``) or after ``max_iter`` iterations (default ``max(100, n // 100)``).
    Empty clusters are re-seeded with rows drawn uniformly by hashed keys (seeded), all
    of an iteration in one aggregate. Returns the last assignment's labels and the
    centres computed from them. ``points`` should be materialised/persisted by the caller.

    With ``state_path`` (a folder of shared storage) each iteration leaves its k centres
    there, and a later call on the same points goes on from the last complete one; a state
    of other points, columns, seed, tolerance or number of clusters is refused.
    """
    cols, spark = list(cols), points.sparkSession
    n_points, units = column_units(points, cols)
    if n_points < k:
        raise ValueError(f"k={k} clusters need at least as many points, got {n_points}")
    if max_iter is None:
        max_iter = max(100, n_points // 100)
    state = load_state(spark, state_path) if state_path else None
    if state:
        r = state[0]
        if (len(state), len(r["centre"]), r["points"], r["seed"], r["tol"]) != (
                k, len(cols), n_points, seed, tol):
            raise ValueError(f"the state under {state_path} is of another fit")
        centers, prev, start, counts = ([list(x[c]) if c != "n" else x[c] for x in state]
                                        for c in ("centre", "previous", "start", "n"))
        shifts, it = list(r["shifts"]), r["iteration"]
    else:
        centers = [list(map(float, c)) for c in init] if init is not None else \
            [s[1] for s in kmeanspp_seeds(points, cols, id_col, k, seed)]
        start = [list(c) for c in centers]
        shifts, counts, prev, it = [], [0] * k, centers, 0
    while it < max_iter and not (shifts and shifts[-1] < tol):
        it += 1
        new, counts = lloyd_step(points, cols, centers, units)
        empty = [j for j in range(k) if new[j] is None]
        if empty:
            keys = [uniform01(seed, f"empty:{it}:{j}", id_col) for j in empty]
            for j, got in zip(empty, _pick_each(points, cols, id_col, keys)):
                new[j] = got[1]
        shifts.append(frobenius_shift(new, centers))
        prev, centers = centers, new
        if state_path:
            save_state(spark, state_path, it, centers, prev, start, counts, shifts, n_points,
                       seed, tol)
    return KMeansResult(centers, assign(points, cols, prev, cluster_col), it, shifts, start,
                        counts, tuple(cols), bool(shifts) and shifts[-1] < tol)


def mllib_kmeans(points: DataFrame, cols: Sequence[str], k: int, seed: int = 42,
                 max_iter: int = 100, tol: float = 1e-4, cluster_col: str = "cluster"):
    """Spark ML's KMeans (k-means|| initialisation, per-centre convergence).
    Offered as an alternative; its clusters differ from :func:`kmeans`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    vec = VectorAssembler(inputCols=list(cols), outputCol="_features").transform(points)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="_features",
                   predictionCol=cluster_col).fit(vec)
    labeled = model.transform(vec).drop("_features")
    return [list(map(float, c)) for c in model.clusterCenters()], labeled
