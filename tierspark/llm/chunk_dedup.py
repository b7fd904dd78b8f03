"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes has its top bits zero, so equal
texts are cut alike and long texts become short lists of chunk identifiers. Chunk
contents move once, to prove that every identifier stands for one content (distinct
contents per identifier are counted). Documents are then grouped by their ordered
identifier lists, never by their text. Should an identifier stand for two contents, the
documents that hold it get the rank of the content added to their lists, so the result
is exact whatever the hash.

Defined cases
* null text counts as empty; empty texts are equal to each other.
* a null ``doc_id`` counts as the smallest id: it stays only in a group without any id.
* rows repeating text and ``doc_id`` carry the same decision (they are one document).
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, whole_text

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 2048, 65536, 12
WINDOW = 32


def _gear():
    """256 pseudo-random 32-bit words, from a multiplicative rule."""
    import numpy as np
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def _lower_bytes(b):
    """A-Z to a-z in a byte array; bytes of longer UTF-8 sequences are above both."""
    import numpy as np
    return np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)


def cut_candidates(b):
    """Positions after which the rolling hash of the last 32 bytes asks for a cut."""
    import numpy as np
    h = _gear()[b]
    step = 1
    while step < WINDOW:
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h, step = nxt, step * 2
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_bounds(cands, lo: int, hi: int) -> list[int]:
    """Chunk ends of one text at bytes [lo, hi): the first candidate at least MIN_CHUNK
    after the last cut, else MAX_CHUNK after it."""
    from bisect import bisect_left
    ends, at = [], lo
    i = 0
    while hi - at > MIN_CHUNK:
        i = bisect_left(cands, at + MIN_CHUNK, i)
        nxt = cands[i] if i < len(cands) and cands[i] < hi else hi
        nxt = min(nxt, at + MAX_CHUNK, hi)
        if nxt >= hi:
            break
        ends.append(nxt)
        at = nxt
    ends.append(hi)
    return ends


def _texts(batch: pa.RecordBatch, col: str):
    """(lower-cased bytes, offsets) of a string column without nulls."""
    import numpy as np
    arr = batch.column(col).cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return _lower_bytes(raw[off[0]:off[-1]]), off - off[0]


def _chunks(batch: pa.RecordBatch, digest_bytes: int):
    """Per row: (memoryview of the text, [(digest, lo, hi)])."""
    import numpy as np
    import xxhash
    low, off = _texts(batch, "t")
    view = memoryview(np.ascontiguousarray(low)).cast("B") if len(low) else memoryview(b"")
    long_rows = np.flatnonzero(off[1:] - off[:-1] > MIN_CHUNK)
    at = {}
    for r in long_rows:
        at[int(r)] = (cut_candidates(low[off[r]:off[r + 1]]) + off[r]).tolist()
    for r in range(len(off) - 1):
        lo, hi = int(off[r]), int(off[r + 1])
        out, start = [], lo
        for end in chunk_bounds(at.get(r, ()), lo, hi):
            out.append((xxhash.xxh3_128_digest(view[start:end])[:digest_bytes], start, end))
            start = end
        yield r, view, lo, hi, out


def _recipes(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        for b in batches:
            sha, rec = [], []
            for _, view, lo, hi, chunks in _chunks(b, digest_bytes):
                sha.append(hashlib.sha256(view[lo:hi]).digest())
                rec.append(b"".join(c[0] for c in chunks))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sha, pa.binary()), pa.array(rec, pa.binary())],
                ["doc_id", "sha", "recipe"])
    return run


def _contents(digest_bytes: int, placed: bool):
    """Chunk rows, once per batch and chunk; ``placed`` adds where each one stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, seen, held = [], set(), 0
            for _, view, lo, hi, chunks in _chunks(b, digest_bytes):
                whole = b"".join(c[0] for c in chunks) if placed else None
                for pos, (dg, s, e) in enumerate(chunks):
                    body = bytes(view[s:e])
                    if placed:
                        rows.append((whole, view[lo:hi].tobytes(), pos, dg, body))
                    elif (dg, body) not in seen:
                        seen.add((dg, body))
                        rows.append((dg, body))
                    held += e - s
                    if held > 4_000_000:
                        yield _batch(rows, placed)
                        rows, held = [], 0
                        seen = set()
            yield _batch(rows, placed)
    return run


def _batch(rows, placed):
    names = ["recipe", "whole", "pos", "id", "content"] if placed else ["id", "content"]
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()] if placed else \
        [pa.binary()] * 2
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _exact_lists(texts: DataFrame, recipes: DataFrame, shared: DataFrame,
                 digest_bytes: int) -> DataFrame:
    """Recipes of the documents that hold a shared identifier, with the rank of the
    chunk's content added to each identifier."""
    ranked = shared.groupBy("id").agg(F.sort_array(F.collect_set("content")).alias("all"))
    rows = texts.mapInArrow(_contents(digest_bytes, True),
                            "recipe binary, whole binary, pos int, id binary, content binary")
    rows = rows.distinct().join(ranked, "id", "left").withColumn(
        "rank", F.coalesce(F.expr("array_position(all, content)"), F.lit(1)))
    lists = rows.groupBy("recipe", "whole").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "rank"))), lambda x: x["rank"]
        .cast("string")), ",").alias("ranks"))
    lists = lists.select(F.unhex(F.sha2("whole", 256)).alias("sha"), "recipe", "ranks")
    return (recipes.join(lists, ["sha", "recipe"], "left")
            .withColumn("recipe", F.concat("recipe", F.coalesce("ranks", F.lit("")).cast("binary")))
            .drop("ranks"))


def dedup_exact(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"))
    recipes = materialize(texts.mapInArrow(_recipes(digest_bytes),
                                           "doc_id long, sha binary, recipe binary"), "recipes")
    contents = (texts.select("t").mapInArrow(_contents(digest_bytes, False),
                                             "id binary, content binary").distinct())
    shared_ids = contents.groupBy("id").count().where("count > 1").select("id")
    shared_ids = materialize(shared_ids, "shared-ids")
    lists = recipes
    if not shared_ids.isEmpty():
        lists = _exact_lists(texts, recipes, contents.join(shared_ids, "id", "left_semi"),
                             digest_bytes)
        lists = materialize(lists, "exact-lists")
    groups = materialize(lists.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"),
                                                     F.count(F.lit(1)).alias("group_size")),
                         "recipe-groups")
    out = lists.join(groups, "recipe")
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def op5_exact_dedup(spark, sf_dir):
    return dedup_exact(documents(spark, sf_dir))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
