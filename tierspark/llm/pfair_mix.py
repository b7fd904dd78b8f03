"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a fixed order, form blocks. With target weight w the j-th block
of a source may be placed from slot floor(j / w) on and must be placed before slot
ceil((j + 1) / w); earliest deadline first among the blocks that may be placed keeps
every prefix of the mix within less than one block of every source's target share.

Weights are whole parts of a total W, so the schedule repeats after W slots: only one
cycle is computed. When a source has no blocks left, the others go on with a new cycle
from the same weights without it (a phase); a phase's length follows from the cycle alone.
So all documents are placed, none is repeated, and the deviation holds in each phase
against the shares of the sources still there.

Every source has a weight of its own. Up to ``max_named`` + 1 of them are scheduled at
once; more are put into groups, each scheduled by itself, and the groups are scheduled in
the same way with the summed weights of their members still there. A source's deviation is
then less than a block per level (64 sources: one level; 4,096: two). Null, and sources
that given weights do not name, share one pooled source. The driver holds a row per source
and the schedule. Default weights are the square roots of the numbers of documents.

Ranking inside a source is split by a hash of the id into ``lanes``, so a source that
holds a third of all rows is numbered by many tasks.

Defined cases
* null source: part of the pooled source. Null text is mixed like any other.
* a null ``doc_id`` counts as the largest id; rows that agree in ``doc_id``, source and
  text take neighbouring places in either order.
* a last block may be shorter than the others.
* an empty table gives an empty result; extra columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Mapping
from heapq import heappop, heappush
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_of, materialize, order_id, whole_text

PARTS = 1000


def cycle(weights: Mapping[int, int], spark: SparkSession | None = None) -> list[int]:
    """The source of each slot of one cycle, for whole weights by source number.

    Block j of a source with weight w is released at floor(j W / w) and due at
    ceil((j + 1) W / w). Equal deadlines go by release, then by source number.
    """
    total = sum(weights.values())
    waiting, ready, out = [(0, n, 0) for n in sorted(weights)], [], []  # released, number, j
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            release, n, j = heappop(waiting)
            heappush(ready, (((j + 1) * total + weights[n] - 1) // weights[n], release, n, j))
        _, _, n, j = heappop(ready)
        out.append(n)
        heappush(waiting, ((j + 1) * total // weights[n], n, j + 1))
    return out


def whole_parts(weights: Mapping[int, float], parts: int = PARTS) -> dict[int, int]:
    """Weights as whole numbers of about ``parts`` in all, at least 1 each."""
    total = sum(weights.values())
    return {n: max(1, round(parts * w / total)) for n, w in weights.items()}


class Plan(NamedTuple):
    """spans: (phase, node, lo, hi, w, total, start), blocks lo to hi of a node in a phase
    that starts at slot ``start`` and has cycles of ``total`` slots; cycles: (phase, node,
    place, in_cycle); steps: what the group is to the level above, see :func:`plan`."""
    spans: list[tuple]
    cycles: list[tuple]
    steps: list[tuple]


def plan(nodes: Mapping[int, list[tuple]]) -> Plan:
    """Schedule of a group of sources, or of groups.

    A node has steps (end, weight, source): up to its block ``end`` it has that weight, and
    with it ``source`` runs out. A source has one step, a group one for each source below.
    A phase ends with the step that ends first, so it ends with the last block of a source,
    and from then on the weights are those of the sources still there.
    """
    step, used = {n: 0 for n, s in nodes.items() if s}, dict.fromkeys(nodes, 0)
    out, start, phase = Plan([], [], []), 0, 0
    while step:
        now = {n: nodes[n][i] for n, i in step.items()}
        weights = whole_parts({n: w for n, (_, w, _) in now.items()})
        slots = cycle(weights)
        total = len(slots)
        places: dict[int, list[int]] = {n: [] for n in step}
        for t, n in enumerate(slots):
            places[n].append(t)
        left = {n: end - used[n] for n, (end, _, _) in now.items()}
        end = {n: (b - 1) // weights[n] * total + places[n][(b - 1) % weights[n]]
               for n, b in left.items()}
        first = min(end, key=end.get)
        length = end[first] + 1
        for n, at in places.items():
            placed = length // total * weights[n] + sum(t < length % total for t in at)
            if placed:
                out.spans.append((phase, n, used[n], used[n] + placed, weights[n], total, start))
            out.cycles.extend((phase, n, i, t) for i, t in enumerate(at) if t < length)
            used[n] += placed
        out.steps.append((start + length, sum(w for _, w, _ in now.values()), now[first][2]))
        step[first] += 1
        if step[first] == len(nodes[first]):
            del step[first]
        start, phase = start + length, phase + 1
    return out


def levels(nodes: Mapping[int, list[tuple]], width: int) -> list[tuple[dict, dict]]:
    """From the sources up to one group: ({node: group}, {group: plan}). Groups hold up to
    ``width`` nodes that run out at about the same time."""
    out = []
    while True:
        order = sorted(nodes, key=lambda n: (nodes[n][-1][0] / max(nodes[n][0][1], 1e-12), n))
        group = {n: i // width for i, n in enumerate(order)}
        plans = {g: plan({n: nodes[n] for n in order[g * width:(g + 1) * width]})
                 for g in range(-(-len(order) // width))}
        out.append((group, plans))
        if len(plans) <= 1:
            return out
        nodes = {g: p.steps for g, p in plans.items()}


def _shares(sizes: DataFrame, weights: Mapping[str, float] | None):
    """({source: number}, {number: rows}, {number: weight}); the number after the named
    sources' is the pool of all others: null, and what ``weights`` does not name."""
    named = sizes.where("source is not null")
    if weights is not None:
        named = named.where(F.col("source").isin(list(weights)))
    top = named.orderBy(F.desc("n"), "source").collect()
    number = {r["source"]: i for i, r in enumerate(top)}
    count = {i: r["n"] for i, r in enumerate(top)}
    pool = (sizes.agg(F.sum("n")).first()[0] or 0) - sum(count.values())
    if weights is None:
        share = {i: n ** 0.5 for i, n in count.items()}
        return number, count | ({len(top): pool} if pool else {}), share | (
            {len(top): pool ** 0.5} if pool else {})
    share = {i: float(weights[s]) for s, i in number.items()}
    if pool:  # what the named weights leave of 1, or as much as the smallest of them
        rest = 1 - sum(weights.values())
        share[len(top)] = rest if rest > 0 else min(share.values(), default=1.0)
        count[len(top)] = pool
    return number, count, share


def _numbered(rows: DataFrame, number: Mapping[str, int]) -> DataFrame:
    """``rows`` with source_no."""
    names = rows.sparkSession.createDataFrame(list(number.items()), "name string, no int")
    return rows.join(F.broadcast(names), F.expr("source = name"), "left").withColumn(
        "source_no", F.coalesce("no", F.lit(len(number)))).drop("name", "no")


def _keys(lanes: int) -> list[Column]:
    d, th = order_id(), F.xxhash64(whole_text())
    return [d.alias("d"), th.alias("th"), F.col("source").cast("string").alias("source"),
            F.pmod(F.xxhash64(d, th), F.lit(lanes)).cast("int").alias("lane")]


def place(rows: DataFrame, keys: DataFrame, weights: Mapping[str, float] | None = None,
          block_rows: int = 16, max_named: int = 63) -> DataFrame:
    """``rows`` (d, th, source, lane and any other column) with source_no, block, phase,
    slot, release, deadline and position. ``keys`` are the same rows' keys, for counting.

    ``position`` numbers the mixed rows without gaps: slot by slot, in order inside.
    """
    spark = rows.sparkSession
    number, count, share = _shares(keys.groupBy("source").agg(F.count(F.lit(1)).alias("n")),
                                   weights)
    before = (Window.partitionBy("source_no").orderBy("lane")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = _numbered(keys.select("source", "lane"), number).groupBy(
        "source_no", "lane").count().select(
        "source_no", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    in_lane = F.row_number().over(
        Window.partitionBy("source_no", "lane").orderBy("d", "th", "source")) - 1
    rows = _numbered(rows, number).withColumn("in_lane", in_lane)
    rows = rows.join(F.broadcast(starts), ["source_no", "lane"])  # sources x lanes rows
    rows = rows.withColumn("block", F.expr(f"(first + in_lane) div {block_rows}"))
    rows = rows.withColumn("in_block", F.expr(f"(first + in_lane) % {block_rows}"))
    blocks = {n: -(-c // block_rows) for n, c in count.items()}
    tree = levels({n: [(b, share[n], n)] for n, b in blocks.items()}, max(2, max_named + 1))
    # slot, release and deadline are blocks of the group so far, then slots of the mix
    rows = rows.withColumns({"node": F.col("source_no"), "slot": F.col("block"),
                             "release": F.col("block"), "deadline": F.expr("block + 1")})
    for group, plans in tree:
        rows = _place_in_groups(rows, group, plans, spark)
    missing, lost = [], 0  # only a source's last block can be short, and it ends a phase
    for phase, (_, _, n) in enumerate(next(iter(tree[-1][1].values()), Plan([], [], [])).steps):
        missing.append((phase, lost))
        lost += blocks[n] * block_rows - count[n]
    missing = spark.createDataFrame(missing, "phase int, missing long")
    rows = rows.join(F.broadcast(missing), "phase")
    position = F.col("slot") * block_rows + F.col("in_block") - F.col("missing")
    return rows.withColumn("position", position.cast("long")).drop(
        "in_lane", "first", "in_block", "lane", "node", "missing")


def _place_in_groups(rows: DataFrame, group: Mapping[int, int], plans: Mapping[int, Plan],
                     spark: SparkSession) -> DataFrame:
    """slot, release and deadline of a node's blocks as those of its group, now ``node``.
    A window of blocks in the group becomes the window from the first block's release to
    the last one's deadline."""
    rows = rows.drop("phase")
    spans = F.broadcast(spark.createDataFrame(
        [(group[n], phase, n, *rest) for p in plans.values() for phase, n, *rest in p.spans],
        "grp int, phase int, node int, lo long, hi long, w long, total long, start long"))
    cycles = F.broadcast(spark.createDataFrame(
        [(phase, n, *rest) for p in plans.values() for phase, n, *rest in p.cycles],
        "phase int, node int, place long, in_cycle long"))

    def during(rows, block):
        s = spans.alias("s")
        return rows.alias("r").join(s, F.expr(
            f"r.node = s.node and {block} >= lo and {block} < hi")).drop(F.col("s.node"))

    def without(rows, *more):
        return rows.drop("grp", "lo", "hi", "w", "total", "start", *more)

    for name, block, value in (
            ("release", "release", "start + (release - lo) * total div w"),
            ("deadline", "deadline - 1", "start + ((deadline - lo) * total + w - 1) div w")):
        rows = without(during(rows, block).withColumn(name, F.expr(value)), "phase")
    rows = during(rows, "slot").withColumn("place", F.expr("(slot - lo) % w"))
    rows = rows.join(cycles, ["phase", "node", "place"])
    rows = rows.withColumn("slot", F.expr("start + (slot - lo) div w * total + in_cycle"))
    return without(rows.withColumn("node", F.col("grp")), "place", "in_cycle")


def mix_positions(docs: DataFrame, weights: Mapping[str, float] | None = None,
                  block_rows: int = 16, lanes: int = 256, max_named: int = 63) -> DataFrame:
    """d, th, source, source_no, block, phase, slot, release, deadline, position."""
    keys = materialize(docs.select(*_keys(lanes)), "mix-keys")
    return place(keys, keys, weights, block_rows, max_named)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = 16,
        lanes: int = 256, max_named: int = 63) -> DataFrame:
    """All rows and columns of ``docs`` in mixed order: range-partitioned and sorted by
    position, so the files, read in order, are the mixed sequence."""
    keys = materialize(docs.select(*_keys(lanes)), "mix-keys")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        *_keys(lanes))
    placed = place(boxed, keys, weights, block_rows, max_named).select("position", "row")
    return (placed.repartitionByRange("position").sortWithinPartitions("position")
            .select("row.*"))


def op3_mix(spark, sf_dir):
    m = mix_positions(documents(spark, sf_dir))
    return m.select(id_of("d").alias("doc_id"), "source", "block", "phase", "slot", "release",
                    "deadline", "position")
