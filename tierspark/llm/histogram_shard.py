"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id). The bytes below candidate boundaries are
counted exactly over all partitions: each round cuts the key range that still holds a
splitter into 256 equal parts (the next eight bits of the key), counts the bytes of each
part, and keeps the part that holds the target, until a boundary is within the tolerance
or the key has no more bits. Only then is every row sent, once, to its shard.

:func:`assign_shards` can take the order of the files it reads as the key instead, which
keeps a mix that an earlier step wrote.

Equal texts have equal hashes, so a group of copies stays in one shard; a splitter falls
inside a group (by doc_id) only if the group is larger than the tolerance.

Defined cases
* size is the UTF-8 length plus 1; null text has size 1 and the crc of the empty text.
* a null ``doc_id`` counts as the largest id.
* rows repeating text and ``doc_id`` cannot be told apart and share a shard.
* an empty table gives an empty result; extra columns of any name are kept by
  :func:`assign_shards`, except that ``shard`` and ``size`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_setting, documents, materialize, order_id, whole_text

BITS = 8
PLACE = "__place__"
FLIP = -(2**63)  # turns signed order into the order of the bits


def keys() -> list[Column]:
    """size, k (hash of the text) and d (id), both keys ordered by their bits."""
    t = whole_text()
    return [(F.octet_length(t) + 1).cast("long").alias("size"),
            F.xxhash64(t).bitwiseXOR(F.lit(FLIP)).alias("k"),
            order_id().bitwiseXOR(F.lit(FLIP)).alias("d")]


def _cell_bytes(rows: DataFrame, key: str, depth: int, parents: list) -> dict:
    """Bytes in each cell of ``depth`` + 8 bits under the open prefixes.

    ``parents`` are prefixes of ``depth`` bits of k, or (k, prefix of d) pairs. At most
    256 cells come back per open prefix, and there are fewer of those than shards.
    """
    lead = [] if key == "k" else ["k"]
    if lead:
        rows = rows.where(F.col("k").isin(sorted({p[0] for p in parents})))
    if depth:
        up = F.shiftrightunsigned(key, 64 - depth)
        rows = rows.where(up.isin(sorted({p if not lead else p[1] for p in parents})))
    cell = F.shiftrightunsigned(key, 64 - depth - BITS).alias("cell")
    got = rows.groupBy(*lead, cell).agg(F.sum("size").alias("b")).collect()
    return {(r["cell"] if not lead else (r["k"], r["cell"])): r["b"] for r in got}


def _signed(v: int) -> int:
    return v - 2**64 if v >= 2**63 else v


def _unsigned(v: int) -> int:
    return v + 2**64 if v < 0 else v


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.002) -> list[tuple[int, int]]:
    """Up to ``shards`` - 1 ascending keys (k, d), as unsigned integers; a row is in the
    shard numbered by how many of them are at or below its key."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    tol = tolerance * total / shards
    found: list[tuple[int, int]] = []
    open_ = [(total * (i + 1) / shards, 0, 0) for i in range(shards - 1)]  # target, prefix, below
    for key in ("k", "d"):
        if key == "d":  # k is down to one value; go on among its rows
            open_ = [(t, (_signed(p), 0), below) for t, p, below in open_]
        for depth in range(0, 64, BITS):
            if not open_:
                return sorted(found)
            sizes = _cell_bytes(rows, key, depth, [p for _, p, _ in open_])
            still = []
            for target, prefix, below in open_:
                k, own = (None, prefix) if key == "k" else prefix
                first, at = own << BITS, below
                for c in range(first, first + 2**BITS):
                    name = _signed(c) if depth + BITS == 64 else c
                    size = sizes.get(name if k is None else (k, name), 0)
                    if at + size >= target:
                        break
                    at += size
                last = key == "d" and depth + BITS == 64
                end = min(((target - at, c), (at + size - target, c + 1)))
                if end[0] <= tol or last:
                    bound = end[1] << (64 - depth - BITS)
                    found.append((bound, 0) if k is None else (_unsigned(k), bound))
                else:
                    still.append((target, c if k is None else (k, c), at))
            open_ = still
    return sorted(found)


def _at_least(col: Column, bound: int) -> Column:
    """Unsigned comparison of a key with a bound of up to 2**64."""
    if bound >= 2**64:
        return F.lit(False)
    return col.bitwiseXOR(F.lit(FLIP)) >= F.lit(_signed(bound ^ 2**63))


def shard_of(cuts: Iterable[tuple[int, int]]) -> Column:
    n = F.lit(0)
    for k, d in cuts:
        past = _at_least(F.col("k"), k)
        if d:
            past = (_at_least(F.col("k"), k + 1)) | (past & _at_least(F.col("d"), d))
        n = n + past.cast("int")
    return n.alias("shard")


def shard_index(docs: DataFrame, shards: int = 16, tolerance: float = 0.002,
                lanes: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot.

    ``slot`` numbers a shard's rows without gaps: a shard's rows go to ``lanes`` lanes by
    a hash of key and id, the lanes' first numbers come from exact counts (shards x lanes
    rows, which is what gets broadcast), and each lane is numbered on its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys(),
                       F.crc32(whole_text().cast("binary")).alias("text_crc32"))
    rows = materialize(rows, "shard-keys")
    lane = F.pmod(F.xxhash64("d", "k"), F.lit(lanes)).cast("int").alias("lane")
    rows = rows.select("*", shard_of(splitters(rows, shards, tolerance)), lane)
    before = (Window.partitionBy("shard").orderBy("lane")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("shard", "lane").count().select(
        "shard", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    in_lane = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("k", "d")) - 1
    out = rows.withColumn("in_lane", in_lane).join(F.broadcast(offsets), ["shard", "lane"])
    return out.select("doc_id", "size", "text_crc32", "shard",
                      (F.col("start") + F.col("in_lane")).cast("long").alias("slot"))


def _in_file_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (read from Parquet files) as (row, at), and the number of rows; ``at``
    numbers the rows without gaps in the order of the part files."""
    meta = docs.metadataColumn("_metadata")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       meta["file_path"].alias("file"), meta["row_index"].alias("in_file"))
    part = F.coalesce(F.expr(r"try_cast(regexp_extract(file, r'part-(\d+)[^/]*$', 1) AS long)"),
                      F.lit(-1))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.first(part).alias("part"))
    starts, total = [], 0
    for r in files.orderBy("part", "file").collect():  # a row per file
        starts.append((r["file"], total))
        total += r["n"]
    starts = docs.sparkSession.createDataFrame(starts, "file string, start long")
    return rows.join(F.broadcast(starts), "file").select(
        "row", (F.col("start") + F.col("in_file")).alias("at")), total


def assign_shards(docs: DataFrame, shards: int = 16, tolerance: float = 0.002,
                  part_bytes: int | None = None, keep_order: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``size`` and ``shard``, exchanged once: rows
    are range-partitioned and sorted by shard and key, in partitions of about
    ``part_bytes`` (default: the size the session asks of a partition), so that a shard
    takes as many tasks as its bytes need.

    With ``keep_order`` the key is a row's place in the files that ``docs`` is read from,
    so that shards are consecutive stretches of them, in their order."""
    spark = docs.sparkSession
    key = keys()
    if keep_order:
        names = docs.columns
        docs, total = _in_file_order(docs)
        # the place fills the key's bits from the top, as a hash does
        at = F.shiftleft("at", 64 - max(1, total.bit_length()))
        docs = docs.select(*[F.col("row").getField(c).alias(c) for c in names], at.alias(PLACE))
        key = [key[0], F.col(PLACE).alias("k"), key[2]]
    key_rows = materialize(docs.select(*key), "shard-keys")
    cuts = splitters(key_rows, shards, tolerance)
    total = key_rows.agg(F.sum("size")).first()[0] or 0
    part_bytes = part_bytes or bytes_setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    kept = [c for c in docs.columns if c.lower() not in ("size", "shard", PLACE)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *key)
    rows = rows.select("*", shard_of(cuts))
    sign = [F.col(c).bitwiseXOR(F.lit(FLIP)) for c in ("k", "d")]
    rows = rows.repartitionByRange(max(shards, -(-total // part_bytes)), "shard", *sign)
    return rows.sortWithinPartitions("shard", *sign).select("row.*", "size", "shard")


def op8_histogram_shard(spark, sf_dir):
    r = shard_index(documents(spark, sf_dir))
    return r.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))
