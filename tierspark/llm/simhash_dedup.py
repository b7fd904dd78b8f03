"""SimHash near-dedup by the generalised pigeonhole principle.

64-bit fingerprints of word shingles link at ``max_bits`` or fewer differing bits;
groups are the connected components of the links.

1. Equal fingerprints collapse to one row first, so copies cost one row however many
   there are.
2. The bits' correlations are counted over all fingerprints; correlated bits are put in
   the same group, so that the groups are nearly independent of each other.
3. If the thresholds t_g of the groups satisfy sum(t_g + 1) = max_bits + 1 (t_g >= -1,
   where -1 leaves a group out), two linked fingerprints differ in at most t_g bits of
   some group g. Dynamic programming over the groups picks the thresholds with the
   smallest estimated cost: probe rows plus candidate pairs, both estimated from exact
   counts of the groups' values over all fingerprints.
4. Fingerprints meet in buckets (group, probed value) and pairs are verified on all 64
   bits. A bucket that holds more than ``crowd`` fingerprints is not paired up: its
   fingerprints go through balls instead (two values at distance <= 2 always have a
   common value at distance <= 1 of both, and at most 65 values share one such centre),
   which is exact and linear in the number of fingerprints.
5. Links become components by alternating large-star and small-star steps on tables.

Defined cases
* null or blank text has fingerprint zero, which links like any other.
* fewer words than the shingle length: the whole sequence is the only shingle.
* a null ``doc_id`` counts as the largest id; a component without any id has a null id,
  and its rows all stay, as nothing tells them apart.
* rows repeating a ``doc_id`` are grouped by their own texts; rows repeating the text as
  well are one document: all stay or none.
* an empty table gives an empty result; extra columns are ignored or kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, id_of, materialize, order_id, release, whole_text

BITS = 64


# ---- fingerprints -------------------------------------------------------------------


def _fingerprint(text: bytes, n: int) -> int:
    import numpy as np
    import xxhash
    words = text.split()  # splits on exactly \x20 and \x09-\x0D
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= n:
        return hash_(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-n].tolist()]
    hashes = np.array([hash_(joined[a:b], 42) for a, b in zip(starts, (ends[n - 1:] - 1).tolist())],
                      np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _fingerprints(n: int):
    up, low = bytes(range(65, 91)), bytes(range(97, 123))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes.maketrans(up, low)
        for b in batches:
            texts = b.column("t").cast(pa.large_binary())
            fps = [_fingerprint(x.as_buffer().to_pybytes().translate(table), n) for x in texts]
            signed = [f - 2**64 if f >= 2**63 else f for f in fps]
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), b.column("th"), pa.array(signed, pa.int64())], ["d", "th", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """d (order key of the id), th (hash of the text) and fp (the fingerprint's 64 bits as
    a signed long)."""
    t = docs.select(order_id().alias("d"), F.xxhash64(whole_text()).alias("th"),
                    whole_text().alias("t"))
    return t.mapInArrow(_fingerprints(shingle), "d long, th long, fp long")


# ---- groups of bits and their thresholds --------------------------------------------


def _co_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, both) of one partition: how often bits i and j are both set."""
    import numpy as np
    both = np.zeros((BITS, BITS), np.int64)
    for b in batches:
        v = np.ascontiguousarray(b.column("fp").to_numpy(zero_copy_only=False))
        x = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1,
                          bitorder="little").astype(np.float32)
        both += (x.T @ x).astype(np.int64)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in (i, j, both[i, j])],
                                     ["i", "j", "both"])


def bit_correlations(fps: DataFrame, n: int):
    """64 x 64 absolute correlations of the bits over all distinct fingerprints."""
    import numpy as np
    both = np.zeros((BITS, BITS))
    rows = fps.select("fp").mapInArrow(_co_counts, "i long, j long, both long")
    for r in rows.groupBy("i", "j").agg(F.sum("both").alias("both")).collect():
        both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["both"] / n
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(sd, sd)), p


def group_bits(corr, groups: int) -> list[list[int]]:
    """Grow ``groups`` groups of near-equal width: each starts at the free bit with the
    largest total correlation and takes the free bits most correlated with it."""
    free, out = set(range(BITS)), []
    for g in range(groups):
        width = (BITS - sum(map(len, out))) // (groups - g)
        own = [max(sorted(free), key=lambda b: sum(corr[b][o] for o in free if o != b))]
        free.remove(own[0])
        while len(own) < width:
            nxt = max(sorted(free), key=lambda b: sum(corr[b][o] for o in own))
            own.append(nxt)
            free.remove(nxt)
        out.append(sorted(own))
    return out


def value_of(bits: list[int]) -> Column:
    """The fingerprint with all other bits cleared."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask))


def ball(width: int, t: int) -> int:
    return sum(math.comb(width, i) for i in range(t + 1)) if t >= 0 else 0


def best_thresholds(cost: list[dict[int, float]], units: int) -> tuple[float, list[int]]:
    """Dynamic programming: give each group u_g = t_g + 1 of ``units`` units in all, at
    the smallest total cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, more in g.items():
                u = used + t + 1
                if u <= units and (u not in nxt or c + more < nxt[u][0]):
                    nxt[u] = (c + more, [*ts, t])
        best = nxt
    return best[units]


def plan(fps: DataFrame, n: int, max_bits: int = 2,
         layouts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """The groups and thresholds with the least estimated cost over all layouts.

    For each group the pairs with equal values are counted exactly; a threshold t
    multiplies them by the number of values within t bits, each weighted by how likely
    its flipped bits differ against how likely they agree.
    """
    corr, p = bit_correlations(fps, n)
    options = []
    for m in layouts:
        groups = group_bits(corr, m)
        cost = []
        for bits in groups:
            same = (fps.groupBy(value_of(bits).alias("v")).count()
                    .agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2))
                    .first()[0] or 0.0)
            odds = [2 * p[b] * (1 - p[b]) / max(1e-9, p[b] ** 2 + (1 - p[b]) ** 2) for b in bits]
            shells = [1.0] + [0.0] * max_bits
            for o in odds:
                for r in range(max_bits, 0, -1):
                    shells[r] += shells[r - 1] * o
            cost.append({-1: 0.0} | {t: n * ball(len(bits), t) + same * sum(shells[:t + 1])
                                     for t in range(max_bits + 1)})
        total, ts = best_thresholds(cost, max_bits + 1)
        options.append((total, list(zip(groups, ts))))
    return min(options, key=lambda o: o[0])[1]


# ---- candidates and links -----------------------------------------------------------


def _flips(bits: list[int], t: int) -> list[int]:
    from itertools import combinations
    out = [0]
    for r in range(1, t + 1):
        out += [sum(1 << b for b in c) for c in combinations(bits, r)]
    return [m - 2**64 if m >= 2**63 else m for m in out]


def probes(fps: DataFrame, layout: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (g, v, fp, own): every value within the group's threshold of the
    fingerprint's own value (``own`` marks that one)."""
    rows = None
    for g, (bits, t) in enumerate(layout):
        if t < 0:
            continue
        flips = F.array(*[F.lit(m) for m in _flips(bits, t)])
        part = fps.select("fp", value_of(bits).alias("x"), F.explode(flips).alias("f"))
        part = part.select(F.lit(g).alias("g"), F.col("x").bitwiseXOR(F.col("f")).alias("v"), "fp",
                           (F.col("f") == 0).alias("own"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _near(max_bits: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits


def ball_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """All links between the given fingerprints up to transitivity, without pairs: each
    joins the buckets of all values within max_bits / 2 bits of it, so members of a bucket
    are near each other, and one link to the smallest member of it stands for all."""
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    flips = F.array(*[F.lit(m) for m in _flips(list(range(BITS)), max_bits // 2)])
    at = fps.select("fp", F.explode(flips).alias("f")).select(
        F.col("fp").bitwiseXOR(F.col("f")).alias("v"), "fp")
    crowd = at.groupBy("v").agg(F.sort_array(F.collect_set("fp")).alias("m")).where("size(m) > 1")
    return (crowd.select(F.expr("m[0]").alias("a"), F.explode(F.expr("slice(m, 2, size(m))"))
                         .alias("b")).distinct())


def links(fps: DataFrame, layout: list[tuple[list[int], int]], max_bits: int = 2,
          crowd: int = 32) -> DataFrame:
    """Linked pairs (a, b) of distinct fingerprints, a < b. All links up to transitivity."""
    at = materialize(probes(fps, layout), "probes")
    sizes = at.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"),
                                     F.max("own").alias("met")).where("n > 1 and met")
    full = materialize(sizes.where(F.col("n") > crowd).select("g", "v"), "crowded")
    few = sizes.where(F.col("n") <= crowd).select("g", "v")
    small = at.join(few, ["g", "v"], "left_semi")
    met = small.groupBy("g", "v").agg(F.collect_list(F.struct("fp", "own")).alias("m"))
    pair = (met.select("m", F.explode("m").alias("x")).where("x.own")
            .select(F.col("x.fp").alias("p"), F.explode("m.fp").alias("q"))
            .where("p != q")
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .where(_near(max_bits)))
    packed = at.join(full, ["g", "v"], "left_semi").select("fp").distinct()
    return pair.unionByName(ball_links(packed, max_bits)).distinct()


# ---- components ---------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest member of each linked fingerprint's component.

    Large-star then small-star until the edges no longer change, which takes a number of
    rounds that grows with the logarithm of the largest component; each step is an
    aggregation and a join of tables written to the shared folder.
    """
    e, seen = materialize(edges.select("a", "b"), "links"), None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("m").alias("a"),
                                                          F.col("v").alias("b"))
                 .where("a < b").distinct())
        large = materialize(large, "large-star")
        release(e)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", "a", "b")
        e = materialize(small.select(F.col("m").alias("a"), "b")
                        .unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
                        .where("a < b").distinct(), "small-star")
        release(large)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == now:
            return e.select(F.col("b").alias("fp"), F.col("a").alias("root"))
        seen = now


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, crowd: int = 32) -> DataFrame:
    """d, th, fp, component (order key of the smallest id reachable), a row per document."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    each = materialize(rows.groupBy("fp").agg(F.min("d").alias("d")), "distinct-fp")
    n = each.count()
    if n < 2:
        layout = [(list(range(BITS)), max_bits)]
    else:
        layout = plan(each, n, max_bits)
    comp = components(links(each.select("fp"), layout, max_bits, crowd))
    named = each.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("d").alias("component"))
    of_fp = materialize(named.join(least, "root").select("fp", "component"), "fp-components")
    return rows.join(of_fp, "fp").select("d", "th", "fp", "component")


def keep_one_of_each_group(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component."""
    # a null id is the largest key: it stays only where its component has no id at all
    gone = near_groups(docs, shingle, max_bits).where("d != component").select("d", "th")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        order_id().alias("d"), F.xxhash64(whole_text()).alias("th"))
    return boxed.join(gone.distinct().hint("shuffle_hash"), ["d", "th"], "left_anti").select("row.*")


def op10_simhash(spark, sf_dir):
    g = near_groups(documents(spark, sf_dir), shingle=3, max_bits=2)
    return g.select(id_of("d").alias("doc_id"),
                    F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    id_of(F.col("component")).alias("component_id"))
