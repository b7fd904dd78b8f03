"""Prefix trie of conversations by vertical bitmaps.

1. Turns travel as the SHA-256 of (role, text) and the text's length, not as text. Shards
   are ranges of ``shard_ids`` consecutive conversation ids; a conversation and the one
   its beginning is taken from lie in the same shard, so rebuilding needs no join.
2. Per shard an index maps (position, turn) to the bitset of the conversations that have
   this turn there. From the root, depth first, the set of a node is intersected with the
   postings of its next position: each result is a child, its number of bits the members,
   and the bits without a next turn are the node's end list. A stack replaces recursion,
   so depth is not limited.
3. A node is named by the SHA-256 of its parent's name and its last turn, so equal nodes
   of different shards meet in one aggregate, a row for each shard. Whatever lies in a
   single shard has its whole subtree there, and is final. For the others the sums over
   subtrees are built by doubling: each node knows its ancestors at distances 1, 2, 4, ...,
   so round k adds the sums of all nodes 2^k below, in one aggregate and one join by name.
   End lists of such nodes are hashed as a stream of the shards' bitsets in order.

Memory: a shard's task holds the hashes of its turns (``shard_ids`` conversations), never
texts; the hash of a node's end list is sequential by its definition and reads one bitset
a shard. Parents with more than a thousandth of all nodes as children (at most 1,000) are
sent to all tasks, the others are joined by name.

Defined results. Null conversation id: belongs to no conversation, left out. Null turns
come first; turns of equal number are ordered by the hash of (role, text); repeated rows
are turns of their own. Null role or text: empty. Texts of any length count whole. Ids
below zero: the group of a hundred begins at the next lower multiple of 100. An empty
table has no node, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

SHARD_IDS, GROUP, HEADS = 1000, 100, 6
NO_ENDS = hashlib.sha256(b"").hexdigest()
SHARD_NODE = ("node binary, parent binary, above array<binary>, depth long, conv_id long, "
              "parent_conv_id long, n_convs long, size long, n_children long, n_leaves long, "
              "saved_tokens long, ends binary, ends_sha256 string, shard long")


def hashed_turns(conversations: DataFrame, shard_ids: int = SHARD_IDS) -> DataFrame:
    """``shard, conv_id, turn, turn_key, size`` of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        key.alias("turn_key"), F.char_length(text).cast("long").alias("size")).where(
        "conv_id IS NOT NULL").withColumn(
        "shard", F.expr(f"(conv_id - pmod(conv_id, {shard_ids})) div {shard_ids}"))


def rebuilt(own: dict) -> dict:
    """Every conversation with the beginning of its group's first one: ``own`` maps ids to
    their turns in order."""
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % HEADS
        out[c] = own.get(c - c % GROUP, [])[:h] + turns[h:]
    return out


def shard_trie(first_id: int, conversations: dict) -> list:
    """The trie of one shard, as dicts in depth-first order; ``conversations`` maps ids
    from ``first_id`` on to lists of (turn key, size)."""
    turns = {c - first_id: t for c, t in conversations.items()}
    postings: list = []   # by position: turn -> bitset of conversations
    longer: list = []     # by position: conversations that have a turn there
    for bit, own in turns.items():
        for p, (key, _) in enumerate(own):
            if p == len(postings):
                postings.append({})
                longer.append(0)
            postings[p][key] = postings[p].get(key, 0) | 1 << bit
            longer[p] |= 1 << bit
    nodes, path = [], []
    every = sum(1 << bit for bit in turns)
    stack = [(hashlib.sha256(b"").digest(), 0, every, 0, None)]
    while stack:
        name, depth, members, size, parent = stack.pop()
        del path[depth:]
        path.append(name)
        rest = members & longer[depth] if depth < len(longer) else 0
        node = {"node": name, "parent": path[depth - 1] if depth else None,
                "above": [path[depth - 2 ** k] for k in range(depth.bit_length())],
                "depth": depth, "conv_id": first_id + (members & -members).bit_length() - 1,
                "parent_conv_id": nodes[parent]["conv_id"] if depth else None,
                "n_convs": members.bit_count(), "size": size, "n_children": 0, "n_leaves": 0,
                "saved_tokens": (members.bit_count() - 1) * size, "ends": members & ~rest,
                "up": parent}
        at = len(nodes)
        nodes.append(node)
        while rest:
            key, length = turns[(rest & -rest).bit_length() - 1][depth]
            child = members & postings[depth][key]
            rest &= ~child
            node["n_children"] += 1
            stack.append((hashlib.sha256(name + key).digest(), depth + 1, child, length, at))
    for node in reversed(nodes):
        node["n_leaves"] += node["n_children"] == 0
        if node["up"] is not None:
            nodes[node["up"]]["n_leaves"] += node["n_leaves"]
            nodes[node["up"]]["saved_tokens"] += node["saved_tokens"]
    return nodes


def bits_of(bits: int, first_id: int):
    """The ids in a bitset, ascending."""
    while bits:
        low = bits & -bits
        yield first_id + low.bit_length() - 1
        bits ^= low


def end_text(bits: int, first_id: int) -> bytes:
    return ",".join(map(str, bits_of(bits, first_id))).encode()


def shard_nodes(turns: DataFrame, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Nodes of every shard's own trie."""

    def build(batches):
        import pyarrow as pa
        types = {"node": pa.binary(), "parent": pa.binary(), "above": pa.list_(pa.binary()),
                 "ends": pa.binary(), "ends_sha256": pa.string()}

        def out(shard, conversations):
            first = shard * shard_ids
            nodes = shard_trie(first, rebuilt(conversations))
            for n in nodes:
                n["shard"], bits = shard, n["ends"]
                n["ends_sha256"] = (hashlib.sha256(end_text(bits, first)).hexdigest()
                                    if bits else NO_ENDS)
                n["ends"] = bits.to_bytes((shard_ids + 7) // 8, "little") if bits else None
            names = [c.split()[0] for c in SHARD_NODE.split(", ")]
            for at in range(0, len(nodes), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n[c] for n in nodes[at:at + 20_000]], types.get(c, pa.int64()))
                     for c in names], names=names)

        now, held = None, {}
        for batch in batches:
            shards, convs, keys, sizes = (batch.column(c).to_pylist() for c in (
                "shard", "conv_id", "turn_key", "size"))
            for shard, conv, key, size in zip(shards, convs, keys, sizes):
                if shard != now:
                    if held:
                        yield from out(now, held)
                    now, held = shard, {}
                held.setdefault(conv, []).append((key, size))
        if held:
            yield from out(now, held)

    ordered = turns.repartition("shard").sortWithinPartitions(
        "shard", "conv_id", F.col("turn").asc_nulls_first(), "turn_key")
    return ordered.select("shard", "conv_id", "turn_key", "size").mapInArrow(build, SHARD_NODE)


def _hash_ends(ends: DataFrame, shard_ids: int) -> DataFrame:
    """SHA-256 of each node's ids over all shards, from rows (node, shard, ends)."""

    def build(batches):
        import pyarrow as pa
        now, state, empty = None, None, True
        for batch in batches:
            names, hashes = [], []
            for node, shard, bits in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if node != now:
                    if now is not None:
                        names.append(now)
                        hashes.append(state.hexdigest())
                    now, state, empty = node, hashlib.sha256(), True
                state.update(b"" if empty else b",")
                state.update(end_text(int.from_bytes(bits, "little"), shard * shard_ids))
                empty = False
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes, pa.string())],
                                             names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()),
                                              pa.array([state.hexdigest()], pa.string())],
                                             names=["node", "ends_sha256"])

    return ends.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(
        build, "node binary, ends_sha256 string")


def subtree_sums(shared: DataFrame) -> DataFrame:
    """``shared`` (node, above, depth, saved_tokens, n_leaves, ...) with its two sums added
    up over whole subtrees, by doubling; every ancestor of a row must be a row."""
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    for k in range(int(deepest).bit_length()):
        below = shared.where(F.size("above") > k).groupBy(F.col("above")[k].alias("node")).agg(
            F.sum("saved_tokens").alias("more_saved"), F.sum("n_leaves").alias("more_leaves"))
        shared = materialize(shared.join(below, "node", "left").withColumns({
            "saved_tokens": F.expr("saved_tokens + coalesce(more_saved, 0L)"),
            "n_leaves": F.expr("n_leaves + coalesce(more_leaves, 0L)"),
        }).drop("more_saved", "more_leaves"), f"trie-sums-{k}")
    return shared


def prefix_trie(conversations: DataFrame, shard_ids: int = SHARD_IDS) -> DataFrame:
    """All nodes of the trie: ``node, parent`` (names), ``conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    if shard_ids % GROUP:
        raise ValueError(f"shard_ids must be a multiple of {GROUP}")
    local = materialize(shard_nodes(hashed_turns(conversations, shard_ids), shard_ids), "trie-shards")
    same = ("parent", "above", "depth", "size", "parent_conv_id", "n_children", "n_leaves",
            "saved_tokens", "ends_sha256")   # the same in all shards, or used of single ones only
    nodes = materialize(local.groupBy("node").agg(
        F.count(F.lit(1)).alias("shards"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), *[F.first(c).alias(c) for c in same]), "trie-nodes")
    single, shared = nodes.where("shards = 1"), nodes.where("shards > 1")

    own = F.col("shards") == 1
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("kids"), F.sum(F.when(own, F.col("saved_tokens"))).alias("saved"),
        F.sum(F.when(own, F.col("n_leaves"))).alias("leaves"))
    shared = materialize(shared.drop("n_children", "saved_tokens", "n_leaves").join(below, "node", "left").select(
        "node", "parent", "above", "depth", "conv_id", "n_convs",
        F.expr("coalesce(kids, 0L)").alias("n_children"),
        F.expr("coalesce(leaves, 0L) + if(kids IS NULL, 1L, 0L)").alias("n_leaves"),
        F.expr("(n_convs - 1) * size + coalesce(saved, 0L)").alias("saved_tokens")), "trie-shared")
    ends = _hash_ends(local.where("ends IS NOT NULL").join(shared.select("node"), "node", "left_semi")
                      .select("node", "shard", "ends"), shard_ids)
    shared = materialize(subtree_sums(shared).join(ends, "node", "left").na.fill(
        {"ends_sha256": NO_ENDS}), "trie-top")

    names = ["node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves",
             "saved_tokens", "ends_sha256"]
    every = single.select(*names, "parent_conv_id").unionByName(
        shared.select(*names, F.lit(None).cast("long").alias("parent_conv_id")))
    hot = F.col("n_children") * 1000 > nodes.count()
    parents = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("by_name"), "n_children")
    few = F.broadcast(parents.where(hot).select("parent", F.col("by_name").alias("by_few")))
    return every.join(few, "parent", "left").join(
        parents.where(~hot).select("parent", "by_name"), "parent", "left").select(
        "node", "parent", "conv_id", "depth",
        F.coalesce("by_few", "by_name", "parent_conv_id").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt ``conversations``. Nulls, ties, repeated rows,
    long texts and an empty table: see the head of this module."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node", "parent")


#: crc32 byte by byte; its table follows from the polynomial.
SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda a, b:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab
  FROM range(256) r(i)),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT c, c - c % {GROUP} AS base, xor(list_reduce(
      [4294967295] || list_transform(range(1, length(c::VARCHAR) + 1), lambda p: ascii((c::VARCHAR)[p:p])::BIGINT),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % {HEADS} AS h
  FROM ids, crc_table),
turns AS (
  SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    length(coalesce(text, '')) AS size
  , turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT c, k, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS p FROM turns),
parts AS (
  SELECT heads.c, p, k, size FROM heads JOIN placed ON placed.c = heads.base AND p < h
  UNION ALL
  SELECT heads.c, p, k, size FROM heads JOIN placed ON placed.c = heads.c AND p >= h),
numbered AS (
  SELECT c, k, size, row_number() OVER (PARTITION BY c ORDER BY p) AS d FROM parts),
prefixes AS (
  SELECT c, d, size, string_agg(k, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS pre FROM numbered
  UNION ALL SELECT c, 0, 0, '' FROM ids),
lengths AS (SELECT c, max(d) AS d FROM prefixes GROUP BY c),
nodes AS (
  SELECT pre, p.d AS depth, min(p.c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE p.d = l.d), '')) AS ends_sha256
  FROM prefixes p JOIN lengths l ON l.c = p.c GROUP BY pre, p.d),
kids AS (SELECT left(pre, -64) AS pre, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY left(pre, -64)),
full_nodes AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.pre = nodes.pre),
sums AS (
  SELECT v.pre, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves,
    sum((u.n_convs - 1) * u.size)::BIGINT AS saved_tokens
  FROM full_nodes v JOIN full_nodes u ON starts_with(u.pre, v.pre) GROUP BY v.pre)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves,
  saved_tokens, v.ends_sha256
FROM full_nodes v JOIN sums ON sums.pre = v.pre
LEFT JOIN full_nodes up ON up.pre = left(v.pre, -64) AND v.depth > 0
"""
