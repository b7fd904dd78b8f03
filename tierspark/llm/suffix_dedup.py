"""Repeated byte strings by suffix sorting in content-chosen buckets.

Every string of ``span`` bytes is filed under its anchor: the substring of ``GRAM`` bytes
with the smallest hash in it (the first of equals). Equal strings have equal anchors at
equal offsets, so only suffixes filed under the same anchor need to be compared, and
neighbouring strings share an anchor, so a text is a list of runs of about a hundred
string starts each.

1. Runs are counted by (anchor, 128-bit digest of the run's bytes). An anchor that occurs
   once settles its run (nothing repeats). A digest that occurs twice says that every
   string in the run repeats; two of its places are then compared on bytes, in stretches
   of neighbouring runs, by the same sort (:func:`compare_stretches`).
2. What is left are the ends of repeated passages. Per anchor, one copy of each different
   run goes to a bucket. Deep-shallow sorting (multikey quicksort, then blind tries)
   orders the suffixes that start at the anchor, and the reversed prefixes that end
   there; the common prefixes of the two orders say which strings any two runs share.
3. A bucket is sorted by one task, in time proportional to its number of runs. A bucket
   of more than ``split`` different runs is dealt out: a string that starts a bytes before
   the anchor, for a in a range of ``WIDTH`` offsets, holds at least the bytes that all
   strings of the range hold, so only runs that agree on those meet in a part, one part
   for each range. Runs that share less than ``span - WIDTH`` bytes never meet.
4. The settled string starts become byte ranges per document, which are cut out.

Texts that take no part in a step are kept away from its shuffle by a bit table of fixed
size, which can let too many through but never too few.

Defined cases
* null text is empty; texts shorter than ``span`` bytes keep everything.
* a null ``doc_id`` counts as the largest id. Rows repeating ``doc_id`` and text are
  separate documents: what they share is removed from all of them.
* cutting may leave bytes that are no longer UTF-8, so the kept text is binary.
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, id_of, materialize, order_id, partitions, whole_text
from .deep_shallow import common_matrix, deep_shallow

GRAM = 64
#: String starts handled at once; below 2**24, the room for positions beside a hash.
BLOCK = 4_000_000
#: Rows a task holds before it hands them on.
AT_ONCE = 30_000
FACTOR = 0x9E3779B97F4A7C15
#: log2 of the bits in a bit table (8 MB).
TABLE_BITS = 26


# ---- runs of string starts with the same anchor -------------------------------------


class _Powers:
    """Powers of the hash factor and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = None

    def of(self, n: int):
        import numpy as np
        if self.up is None or len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.full(size, f, np.uint64) for f in
                                  (FACTOR, pow(FACTOR, -1, 2**64)))
            for a in (self.up, self.down):
                a[0] = 1
                np.multiply.accumulate(a, out=a)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def gram_hashes(b, k: int):
    """64-bit hash of the k bytes at each position."""
    import numpy as np
    up, down = _POWERS.of(len(b))
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up)])
    x = (c[k:] - c[:-k]) * down[:len(b) - k + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _first_minima(h, w: int):
    """Position of the first smallest value in each window of w values."""
    import numpy as np
    low = np.uint64((1 << 24) - 1)
    v = np.full(-(-len(h) // w) * w, np.uint64(2**64 - 1))
    v[:len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    v = v.reshape(-1, w)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    return (np.minimum(behind[:n], ahead[w - 1:w - 1 + n]) & low).astype(np.int64)


def runs(text: bytes, span: int, gram: int = GRAM):
    """(lo, hi, anchor, anchor's hash) of the runs of string starts lo..hi of a text."""
    import numpy as np
    gram = min(gram, span)
    for at in range(0, len(text) - span + 1, BLOCK):
        part = text[at:at + BLOCK + span - 1]
        h = gram_hashes(np.frombuffer(part, np.uint8), gram)
        a = _first_minima(h, span - gram + 1)
        cut = np.flatnonzero(a[1:] != a[:-1]) + 1
        lo = np.concatenate([[0], cut])
        hi = np.concatenate([cut, [len(a)]]) - 1
        p = a[lo]
        yield from zip((lo + at).tolist(), (hi + at).tolist(), (p + at).tolist(),
                       h[p].view(np.int64).tolist())


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _runs(span: int, placed: bool):
    """Rows (h, u) of a batch with their numbers, or one row per run with its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import xxhash
        digest = xxhash.xxh3_128_intdigest
        for b in batches:
            count: Counter = Counter()
            rows: list[tuple] = []
            ids = zip(b.column("d").to_pylist(), b.column("th").to_pylist()) if placed else None
            for t in b.column("t").cast(pa.large_binary()):
                text = t.as_buffer().to_pybytes()
                own = next(ids) if placed else None
                for lo, hi, p, h in runs(text, span):
                    both = digest(text[lo:hi + span], p - lo)
                    u, v = _signed(both >> 64), _signed(both & 2**64 - 1)
                    if placed:
                        rows.append((*own, lo, hi, p - lo, h, u, v))
                    else:
                        count[h, u, v] += 1
                if len(rows) + len(count) > AT_ONCE:
                    yield _to_batch(rows, RUN) if placed else _to_batch(
                        [(*k, n) for k, n in count.items()], COUNT)
                    rows, count = [], Counter()
            if placed:
                yield _to_batch(rows, RUN)
            else:
                yield _to_batch([(*k, n) for k, n in count.items()], COUNT)
    return run


COUNT = {"h": pa.int64(), "u": pa.int64(), "v": pa.int64(), "n": pa.int64()}
RUN = {"d": pa.int64(), "th": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "off": pa.int64(),
       "h": pa.int64(), "u": pa.int64(), "v": pa.int64()}
SLICE = {"h": pa.int64(), "part": pa.int64(), "from_a": pa.int64(), "u": pa.int64(), "v": pa.int64(),
         "off": pa.int64(), "once": pa.bool_(), "content": pa.binary()}
RANGE = {"h": pa.int64(), "u": pa.int64(), "v": pa.int64(), "first": pa.int64(), "last": pa.int64()}
ODD = {"id": pa.int64(), "common": pa.int64()}
#: Offsets of a range of a bucket that is dealt out.
WIDTH = 48


def _to_batch(rows, kinds) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())],
                                      list(kinds))


def _schema(kinds) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{n} {names[k]}" for n, k in kinds.items())


# ---- bit tables ----------------------------------------------------------------------


def _bit(*cols: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - TABLE_BITS)


def _bit_table(keys: DataFrame):
    """Broadcast bits of all (d, th) of ``keys``: at most 2**TABLE_BITS bits."""
    import numpy as np
    x = keys.select((_bit("d", "th") + 1).alias("x"))  # the bitmap functions count from 1
    got = x.groupBy(F.expr("bitmap_bucket_number(x)").alias("n")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits"))
    table = np.zeros((2**TABLE_BITS >> 15) + 1, dtype=object)
    for r in got.toLocalIterator():
        table[r["n"]] = bytes(r["bits"])
    blank = bytes(4096)
    return keys.sparkSession.sparkContext.broadcast(b"".join(x or blank for x in table))


def _maybe(docs: DataFrame, held, inside: bool) -> DataFrame:
    """The rows of ``docs`` that the table may hold, or surely doesn't."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        bits = np.frombuffer(held.value, np.uint8)
        for b in batches:
            x = b.column("x").to_numpy(zero_copy_only=False)
            n, p = (x >> 15) + 1, x & 32767
            hit = (bits[n * 4096 + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
            yield b.filter(pa.array(hit == inside))

    x = docs.withColumn("x", _bit("d", "th"))
    return x.mapInArrow(run, x.schema).drop("x")


# ---- buckets -------------------------------------------------------------------------


def shared_strings(slices: list[tuple[int, bytes]], span: int) -> list[list[tuple[int, int]]]:
    """Of runs (anchor's offset, bytes) with one anchor: per run the ranges of offsets a
    (anchor minus string start) of the strings that another run holds too.

    The string at offset a is the last a bytes before the anchor and span - a bytes from
    it on, so two runs share it if they agree that far in both orders. Few runs are
    compared in pairs; many are numbered, for each a, by how far neighbours agree, which
    takes time in proportion to their number.
    """
    right = deep_shallow([c[off:] for off, c in slices])
    left = deep_shallow([c[:off][::-1] for off, c in slices])
    if len(slices) <= PAIRWISE:
        return _by_pairs(left, right, span)
    return _by_classes(left, right, span, max(off for off, _ in slices))


#: Up to so many runs, comparing all of a bucket in pairs is the faster form.
PAIRWISE = 48


def _by_pairs(left, right, span: int) -> list[list[tuple[int, int]]]:
    import numpy as np
    r, l = common_matrix(*right), common_matrix(*left)
    lo = np.maximum(span - r, 0)
    ok = (lo <= l) & ~np.eye(len(r), dtype=bool)
    out = []
    for m in range(len(r)):
        own: list[tuple[int, int]] = []
        for a, b in sorted(zip(lo[m][ok[m]].tolist(), l[m][ok[m]].tolist())):
            if own and a <= own[-1][1] + 1:
                own[-1] = (own[-1][0], max(own[-1][1], b))
            else:
                own.append((a, b))
        out.append(own)
    return out


def _by_classes(left, right, span: int, widest: int) -> list[list[tuple[int, int]]]:
    import numpy as np
    n = len(left[0])

    def classes(order, common, depth):
        """Number of each run's class of equal first ``depth`` bytes."""
        own = np.empty(n, np.int64)
        own[order] = np.cumsum(np.array(common) < depth)
        return own

    (lo, lc), (ro, rc) = left, right
    hit = np.zeros((widest + 3, n), np.int8)  # a row of zeros before and after
    for a in range(min(widest, span) + 1):
        key = classes(lo, lc, a) * (n + 1) + classes(ro, rc, span - a)
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        hit[a + 1] = count[at] > 1
    edge = np.diff(hit, axis=0)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    firsts, lasts = np.argwhere(edge.T == 1), np.argwhere(edge.T == -1)
    for (m, a), (_, b) in zip(firsts.tolist(), lasts.tolist()):
        out[m].append((a, b - 1))
    return out


def _sort_buckets(span: int):
    """Rows sorted by (h, part, from_a) -> ranges of string starts, relative to the run,
    that repeat. A part (``from_a`` not negative) answers for its own offsets only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != key:
                    out += _of_bucket(group, span)
                    key, group = row[:3], []
                group.append(row)
            yield _to_batch(out, RANGE)
        yield _to_batch(_of_bucket(group, span), RANGE)
    return run


def _of_bucket(group, span: int) -> list[tuple]:
    if len(group) < 2:
        return []
    low = group[0][2]
    high = low + WIDTH - 1 if low >= 0 else span
    found = shared_strings([(g[5], g[7]) for g in group], span)
    return [(h, u, v, off - min(b, high), off - max(a, low)) for (h, _, _, u, v, off, once, _), ranges
            in zip(group, found) if once for a, b in ranges if max(a, low) <= min(b, high)]


def _parts(span: int):
    """Slices of a bucket that is dealt out -> a row for each range of offsets that the
    slice has strings of, with the hash of the bytes that all those strings hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for b in batches:
            rows: list[tuple] = []
            for h, _, _, u, v, off, once, c in zip(*(c.to_pylist() for c in b.columns)):
                for low in range(0, off + 1, WIDTH):
                    # strings start at off - a; the last one of the content at len(c) - span
                    least, most = max(low, off - (len(c) - span)), min(low + WIDTH - 1, off)
                    if least <= most:
                        common = c[off - low:off + span - (low + WIDTH - 1)]
                        rows.append((h, _signed(xxhash.xxh3_64_intdigest(common)), low, u, v, off, once, c))
                if len(rows) > AT_ONCE // 8:
                    yield _to_batch(rows, SLICE)
                    rows = []
            yield _to_batch(rows, SLICE)
    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, side, content) sorted by id -> the stretches whose two sides differ."""
    held = None
    for b in batches:
        odd = []
        for id_, _, content in zip(*(c.to_pylist() for c in b.columns)):
            if held is None or held[0] != id_:
                held = (id_, content)
                continue
            _, common = deep_shallow([held[1], content])
            if not len(content) == len(held[1]) == common[1]:
                odd.append((id_, common[1]))
            held = None
        yield _to_batch(odd, ODD)


def compare_stretches(texts: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """(id, common) of repeated stretches whose bytes differ after all; none is expected.

    Of each digest that occurs twice the first and the last place are compared.
    Neighbouring runs of one document whose other places are neighbours too form one
    stretch, so a text is moved about once, however many runs it has."""
    place = F.struct("d", "th", "lo", "hi")
    ends = found.where("n > 1").groupBy("h", "u", "v").agg(F.min(place).alias("p"), F.max(place).alias("q"))
    ends = ends.where("p <> q").select("p.*", F.col("q.d").alias("d2"), F.col("q.th").alias("th2"),
                                       (F.col("q.lo") - F.col("p.lo")).alias("by"))
    pair = ["d", "th", "d2", "th2", "by"]
    w = Window.partitionBy(*pair).orderBy("lo")
    begins = F.coalesce(F.lag("hi").over(w) + 1 != F.col("lo"), F.lit(True)).cast("int")
    islands = ends.withColumn("begins", begins).withColumn("island", F.sum("begins").over(w))
    stretches = materialize(islands.groupBy(*pair, "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn(
        "id", F.monotonically_increasing_id()), "stretches")
    sides = stretches.select("id", F.lit(0).alias("side"), "d", "th", "lo", "hi").unionByName(
        stretches.select("id", F.lit(1).alias("side"), F.col("d2").alias("d"), F.col("th2").alias("th"),
                         (F.col("lo") + F.col("by")).alias("lo"), (F.col("hi") + F.col("by")).alias("hi")))
    wanted = sides.groupBy("d", "th").agg(F.collect_list(F.struct("id", "side", "lo", "hi")).alias("want"))
    near = _maybe(texts, _bit_table(sides), True).dropDuplicates(["d", "th"])
    rows = near.join(wanted, ["d", "th"]).select(F.col("t").cast("binary").alias("t"),
                                                 F.explode("want").alias("w"))
    rows = rows.select("w.id", "w.side", F.expr(
        f"substring(t, cast(w.lo as int) + 1, cast(w.hi - w.lo as int) + {span})").alias("content"))
    rows = rows.repartition(partitions(texts.sparkSession), "id").sortWithinPartitions("id", "side")
    return rows.mapInArrow(_compare, _schema(ODD))


# ---- the operator --------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    t = docs.select(order_id().alias("d"), whole_text().alias("t"))
    return t.select("d", F.xxhash64("t").alias("th"), "t")


def repeated_ranges(docs: DataFrame, span: int = 400, split: int = 256) -> DataFrame:
    """(d, th, cuts): per document the byte ranges to cut, not yet merged."""
    texts, run = _texts(docs), ["h", "u", "v"]
    counted = texts.select("t").mapInArrow(_runs(span, False), _schema(COUNT))
    counted = counted.groupBy(*run).agg(F.sum("n").alias("n"))
    counted = materialize(counted, "run-counts")
    anchors = counted.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
    marks = counted.join(anchors.where("all > 1").drop("all"), "h")
    marks = materialize(marks, "run-marks")
    placed = texts.mapInArrow(_runs(span, True), _schema(RUN))
    found = materialize(placed.join(marks, run), "repeated-runs")
    odd = compare_stretches(texts, found, span).take(1)
    if odd:
        raise RuntimeError(f"two different runs have one 128-bit digest: {odd[0]}")

    place = F.struct("d", "th", "lo", "hi", "off")
    one_each = found.where("kinds > 1").groupBy(*run).agg(
        F.min(place).alias("p"), F.first("n").alias("n"), F.first("kinds").alias("kinds"))
    one_each = materialize(one_each.select(*run, "n", "kinds", "p.*"), "edge-runs")
    wanted = one_each.groupBy("d", "th").agg(F.collect_list(F.struct(
        *run, "lo", "hi", "off", "n", "kinds")).alias("want"))
    near = _maybe(texts, _bit_table(one_each), True).dropDuplicates(["d", "th"])
    slices = near.join(wanted, ["d", "th"]).select(F.col("t").cast("binary").alias("t"),
                                                  F.explode("want").alias("w"))
    slices = slices.select("w.h", F.lit(0).cast("long").alias("part"), F.lit(-1).cast("long").alias("from_a"),
                           "w.u", "w.v", "w.off", (F.col("w.n") == 1).alias("once"),
                           F.expr(f"substring(t, cast(w.lo as int) + 1, "
                                  f"cast(w.hi - w.lo as int) + {span})").alias("content"), "w.kinds")
    slices = materialize(slices, "edge-slices")
    few, many = (slices.where(c).drop("kinds") for c in (F.col("kinds") <= split, F.col("kinds") > split))
    dealt = few.unionByName(many.mapInArrow(_parts(span), _schema(SLICE)))
    dealt = dealt.repartition(partitions(docs.sparkSession), "h", "part", "from_a").sortWithinPartitions(
        "h", "part", "from_a")
    edges = dealt.mapInArrow(_sort_buckets(span), _schema(RANGE))

    settled = found.where("n > 1").select("d", "th", F.col("lo").alias("first"),
                                          F.col("hi").alias("last"))
    rest = found.where("n = 1 and kinds > 1").select("d", "th", "lo", *run).join(
        edges, run).select("d", "th", (F.col("lo") + F.col("first")).alias("first"),
                           (F.col("lo") + F.col("last")).alias("last"))
    cut = F.struct(F.col("first").alias("a"), (F.col("last") + span).alias("b"))
    return settled.unionByName(rest).groupBy("d", "th").agg(F.collect_list(cut).alias("cuts"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their ranges -> sizes, number of merged ranges, and what is left."""
    for b in batches:
        rows = []
        for d, t, cuts in zip(*(b.column(c).to_pylist() for c in ("d", "t", "cuts"))):
            text = t.encode("utf-8")
            merged: list[list[int]] = []
            for c in sorted((c["a"], c["b"]) for c in cuts):
                if merged and c[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], c[1])
                else:
                    merged.append(list(c))
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(text[at:lo])
                at = hi
            kept.append(text[at:])
            rows.append((d, len(text), sum(hi - lo for lo, hi in merged), len(merged),
                         ",".join(f"{lo}:{hi}" for lo, hi in merged), b"".join(kept)))
        yield _to_batch(rows, RESULT)


RESULT = {"d": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
          "spans": pa.string(), "kept": pa.binary()}


def remove_repeats(docs: DataFrame, span: int = 400, split: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (``from:to`` in bytes, end exclusive,
    comma-joined), kept (bytes), one row per row of ``docs``."""
    cuts = materialize(repeated_ranges(docs, span, split), "cuts")
    held, texts = _bit_table(cuts.select("d", "th")), _texts(docs)
    zero = F.lit(0).cast("long")
    whole = (F.octet_length("t").cast("long").alias("n_bytes"), zero.alias("n_removed"),
             zero.alias("n_spans"), F.lit("").alias("spans"), F.col("t").cast("binary").alias("kept"))
    away = _maybe(texts, held, False).select("d", *whole)
    near = _maybe(texts, held, True).join(cuts.hint("shuffle_hash"), ["d", "th"], "left")
    near = near.select("d", "t", F.coalesce("cuts", F.array()).alias("cuts"))
    near = near.mapInArrow(_cut, _schema(RESULT))
    return away.unionByName(near).withColumn("doc_id", id_of("d")).drop("d")


def op4_suffix(spark, sf_dir):
    """Whole ``documents`` without bytes of repeated 400-byte strings: the digests, the
    spans removed, and the text that is left (a letter cut in two shows as U+FFFD; the hash
    is of the bytes). Nulls, ties, repeated rows, empty and long texts: see the head."""
    r = remove_repeats(documents(spark, sf_dir), span=400)
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans",
                    F.sha2("kept", 256).alias("kept_sha256"), "spans",
                    F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
