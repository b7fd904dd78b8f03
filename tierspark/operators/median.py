"""Exact per-group medians without gathering a group into one task.

``F.median`` / ``percentile`` buffer every distinct value of a group in one
aggregation buffer, so one large group (a cluster can hold a third of all rows)
would land in a single task. Instead the values are put in order once, by (group,
column, value), over ranges that Spark samples, and ranked where they lie:

1. A (group, column) whose values all lie inside one range is settled there: the task
   reads its sorted values as a stream and takes the middle ones.
2. The first and the last (group, column) of a range may go on in its neighbours. Their
   values are written with their place; as each range has at most two of them, a table
   of at most two rows a range says how many values lie before, hence at which place
   of which range the middle ones are.

The values move once, however many groups there are and however large one is: equal
values of a group are told apart by the input partition they come from, so that they
too may be dealt over several ranges. A range holds about ``window_rows`` values, or
more where that would take over ``spark.sql.shuffle.partitions`` ranges, but not over
``AT_ONCE`` as long as ``MOST`` ranges suffice.

The median of an even count is ``(a + b) / 2`` of the two middle values. NULL and NaN
values are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tierspark.session import materialize, release

#: Values that a task puts in order, and the ranges that a driver can plan.
AT_ONCE = 4_000_000
MOST = 20_000


def _ranked():
    """Rows (keys, v) of one range, sorted -> a row (keys, median) for each key inside the
    range, and the rows (keys, v, range, run, place) of its first and last key."""
    import numpy as np
    import pyarrow.compute as pc
    from pyspark import TaskContext

    def changes(column: pa.Array):
        """For each value but the first, whether it differs from the one before; NULL equals
        NULL and NaN equals NaN."""
        if pa.types.is_nested(column.type):
            x = column.to_pylist()
            return np.array([a != b for a, b in zip(x[1:], x)], bool)
        new, old = column[1:], column[:-1]
        differs = pc.fill_null(pc.not_equal(new, old), False)
        if pa.types.is_floating(column.type):
            both = pc.and_(pc.is_nan(new), pc.is_nan(old))
            differs = pc.and_not(differs, pc.fill_null(both, False))
        differs = pc.or_(differs, pc.xor(new.is_null(), old.is_null()))
        return differs.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()

        def rows(keys, v, run=None, at=None):
            own = [pa.nulls(len(v), t) if run is None else pa.array(np.full(len(v), x), t)
                   for x, t in ((pid, pa.int32()), (run, pa.int32()))]
            place = pa.nulls(len(v), pa.int64()) if run is None else pa.array(
                np.arange(at, at + len(v), dtype=np.int64))
            names = [*(f"key_{i}" for i in range(len(keys) - 1)), "feature", "v", "pid", "run", "at"]
            return pa.RecordBatch.from_arrays([*keys, pa.array(v), *own, place], names)

        last = None            # the keys of the row before
        first, seen = True, 0  # still in the first run, and its rows so far
        held: list = []        # values of a later run that has not ended yet
        for b in batches:
            if not b.num_rows:
                continue
            keys, v = b.columns[:-1], b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            begins = np.zeros(b.num_rows, bool)
            for k, before in zip(keys, last or keys):
                k = k if last is None else pa.concat_arrays([before, k])
                begins[int(last is None):] |= changes(k)
            starts = np.flatnonzero(begins)
            head = int(starts[0]) if len(starts) else len(v)
            if first:
                if head:
                    yield rows([k[:head] for k in keys], v[:head], 0, seen)
                seen += head
            else:
                held.append(v[:head])
            if len(starts):
                ends = starts[1:]
                sizes = ends - starts[:-1]
                middle = (v[starts[:-1] + (sizes - 1) // 2] + v[starts[:-1] + sizes // 2]) / 2
                done = [k.take(pa.array(starts[:-1])) for k in keys]
                if not first:
                    x = np.concatenate(held)
                    yield rows(last, np.array([(x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2]))
                if len(middle):
                    yield rows(done, middle)
                first, held = False, [v[starts[-1]:]]
            last = [k[-1:] for k in keys]
        if not first:
            x = np.concatenate(held)
            for at in range(0, len(x), 100_000):
                part = x[at:at + 100_000]
                same = pa.array(np.zeros(len(part), np.int64))
                yield rows([k.take(same) for k in last], part, 1, at)

    return run


def exact_medians(df: DataFrame, group_cols: Sequence[str], value_cols: Sequence[str],
                  window_rows: int = 20_000) -> DataFrame:
    """Wide result: ``group_cols`` + one median column per ``value_cols`` entry
    (NULL when a group has no value in that column), a row per group that has a value in
    any column; without ``group_cols`` exactly one row. The result is a written table."""
    spark, gcols = df.sparkSession, list(group_cols)
    groups = [f"key_{i}" for i in range(len(gcols))]
    keys = groups + ["feature"]
    long = df.select(*[F.col(c).alias(k) for c, k in zip(gcols, groups)],
                     F.spark_partition_id().alias("source"),
                     F.posexplode(F.array(*[F.col(c).cast("double") for c in value_cols])).alias("feature", "v"))
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v"))
    total, tasks = long.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST, max(1, min(-(-total // window_rows), max(tasks, -(-total // AT_ONCE)))))
    order = long.repartitionByRange(ranges, *keys, "v", "source").sortWithinPartitions(*keys, "v")
    order = order.select(*keys, "v")
    schema = StructType(list(order.schema)).add("pid", IntegerType()).add(
        "run", IntegerType()).add("at", LongType())
    runs = materialize(order.mapInArrow(_ranked(), schema), "median-runs")

    across = runs.where("at IS NOT NULL")
    inside = Window.partitionBy(*keys)
    before = F.sum("n").over(inside.orderBy("pid", "run").rowsBetween(Window.unboundedPreceding, -1))
    places = (across.groupBy(*keys, "pid", "run").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(before, F.lit(0))).withColumn("all", F.sum("n").over(inside))
              .selectExpr("pid", "run", "(all - 1) div 2 - before AS r0", "all div 2 - before AS r1"))
    picked = (across.join(F.broadcast(places), ["pid", "run"]).where("at = r0 OR at = r1")
              .groupBy(*keys).agg(F.min("v").alias("a"), F.max("v").alias("b")))
    medians = runs.where("at IS NULL").select(*keys, "v").unionByName(
        picked.select(*keys, ((F.col("a") + F.col("b")) / 2).alias("v")))
    out = materialize(medians.groupBy(*[F.col(k).alias(c) for c, k in zip(gcols, groups)]).agg(
        *[F.max(F.when(F.col("feature") == i, F.col("v"))).alias(c) for i, c in enumerate(value_cols)]),
        "medians")
    release(runs)
    return out
