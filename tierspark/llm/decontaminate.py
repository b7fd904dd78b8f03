"""Benchmark decontamination by rare seeds and Smith-Waterman alignment.

Texts and benchmark items become lower-case words without punctuation. Every sequence of
``seed`` words of an item is a seed; a first pass counts in how many documents each seed
occurs. In a second pass seeds join passages to items: a passage is aligned with an item
if it shares a rare seed with it, or several different seeds of any frequency (so an item
that was copied into very many documents, whose seeds are no longer rare, is still
found). Smith-Waterman over words then scores the passage, which tolerates replaced,
dropped and added words. Both passes are maps over the documents: no text is shuffled.

The benchmark goes to all tasks in blocks of at most ``block_bytes`` of text; a larger
benchmark takes more rounds over the documents.

Defined cases
* null or empty text matches nothing; items that are null or shorter than ``min_words``
  words are not searched (they are too short to be told from ordinary prose).
* repeated items and repeated rows each get their own matches; a null ``doc_id`` or
  ``item_id`` is carried along.
* an empty table, or an empty benchmark, gives no match, and all documents stay.
* extra columns of any name are ignored or kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

MATCH, MISMATCH, GAP = 2, -2, -2
#: Words around the place where seeds put an item that take part in the alignment.
SLACK = 12


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split() if text else []


_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _best_end(score, item, passage):
    """(score, rows, columns) of the best local alignment's end."""
    import numpy as np
    gaps = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best = (0, 0, 0)
    for i, w in enumerate(item, 1):
        nxt = np.maximum(row + GAP, 0)
        nxt[1:] = np.maximum(nxt[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(nxt + gaps) - gaps
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j)
            if best[0] == score:
                break
    return best


def smith_waterman(item, passage) -> tuple[int, int, int]:
    """(score, first column, end column) of the best local alignment of two arrays."""
    score, i, j = _best_end(None, item, passage)
    if not score:
        return 0, 0, 0
    _, _, back = _best_end(score, item[:i][::-1], passage[:j][::-1])
    return score, j - back, j


class Items:
    """The items of a block: vocabulary, seeds and where the seeds stand in the items."""

    def __init__(self, rows: list[tuple], seed: int, min_words: int):
        import numpy as np
        self.seed, self.vocab = seed, {}
        self.ids, self.texts = [], []
        at: dict[tuple, list] = defaultdict(list)
        for item_id, text in rows:
            w = words(text)
            if len(w) < max(seed, min_words):
                continue
            codes = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64)
            for p in range(len(codes) - seed + 1):
                at[tuple(codes[p:p + seed].tolist())].append((len(self.ids), p))
            self.ids.append(item_id)
            self.texts.append(codes)
        self.number = {s: n for n, s in enumerate(at)}
        self.places = list(at.values())
        self.rare = np.ones(len(at), bool)

    def codes(self, text):
        """Word numbers (0: in no item) and the (position, seed number) hits of a text."""
        import numpy as np
        get = self.vocab.get
        c = np.array([get(w, 0) for w in words(text)], np.int64)
        n = len(c) - self.seed + 1
        if n <= 0:
            return c, []
        known = np.flatnonzero(np.logical_and.reduce(
            [c[k:k + n] > 0 for k in range(self.seed)]))
        number = self.number
        hits = []
        for p in known.tolist():
            s = number.get(tuple(c[p:p + self.seed].tolist()))
            if s is not None:
                hits.append((p, s))
        return c, hits

    def matches(self, text, least: float, words_least: int, common: int):
        """(item number, score, first word, end word) of each item found in a text."""
        c, hits = self.codes(text)
        by_item = defaultdict(list)
        for p, s in hits:
            for item, q in self.places[s]:
                by_item[item].append((p, q, s))
        out = []
        for item, found in sorted(by_item.items()):
            own = self.texts[item]
            best = None
            for part in _clusters(found, len(own)):
                seeds = {s for _, _, s in part}
                enough = min(common, len(own) - self.seed + 1)
                if len(seeds) < enough and not any(self.rare[s] for s in seeds):
                    continue
                lo = max(0, min(p - q for p, q, _ in part) - SLACK)
                hi = max(p - q for p, q, _ in part) + len(own) + SLACK
                score, a, b = smith_waterman(own, c[lo:hi])
                if score >= least * MATCH * len(own) or score >= MATCH * words_least:
                    share = score / (MATCH * len(own))
                    if best is None or share > best[1]:
                        best = (item, share, lo + a, lo + b)
            if best:
                out.append(best)
        return out


def _clusters(found, length: int):
    """Hits in order of position, cut where the item would no longer reach."""
    part: list = []
    for hit in sorted(found):
        if part and hit[0] - part[-1][0] > length + SLACK:
            yield part
            part = []
        part.append(hit)
    yield part


def blocks(docs: DataFrame, benchmark: DataFrame, seed: int = 3, min_words: int = 8,
           rare_share: float = 0.001, block_bytes: int = 16_000_000) -> Iterator:
    """Broadcast :class:`Items` with the rarity of their seeds, block by block."""
    sc = docs.sparkSession.sparkContext
    text = F.col("text").cast("string")
    items = benchmark.select("item_id", text.alias("text")).where(text.isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        own = Items([tuple(r) for r in items.where(part == k).collect()], seed, min_words)
        if not own.ids:
            continue
        held = sc.broadcast(own)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, int] = defaultdict(int)
            for b in batches:
                found[-1] += b.num_rows
                for t in b.column("text").to_pylist():
                    for s in {s for _, s in held.value.codes(t)[1]}:
                        found[s] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()),
                                              pa.array(list(found.values()), pa.int64())],
                                             ["s", "n"])

        got = (docs.select(text.alias("text")).mapInArrow(count, "s long, n long")
               .groupBy("s").agg(F.sum("n").alias("n")).collect())
        seen = {r["s"]: r["n"] for r in got}
        for s, c in seen.items():
            if s >= 0:
                own.rare[s] = c <= max(10, rare_share * seen[-1])
        held.unpersist()
        yield sc.broadcast(own)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, words_least: int = 20,
          common: int = 3, **options) -> DataFrame:
    """doc_id, item_id, score (share of the item's own score), first_word, end_word."""
    numbers = dict(benchmark.dtypes)["item_id"] in ("tinyint", "smallint", "int", "bigint")
    kinds = {"doc_id": pa.int64(), "item_id": pa.int64() if numbers else pa.string(),
             "score": pa.float64(), "first_word": pa.int64(), "end_word": pa.int64()}
    schema = (f"doc_id long, item_id {'long' if numbers else 'string'}, score double, "
              "first_word long, end_word long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    benchmark = benchmark.withColumn("item_id", F.col("item_id").cast(
        "long" if numbers else "string"))
    out = docs.sparkSession.createDataFrame([], schema)
    for held in blocks(docs, benchmark, **options):
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for b in batches:
                found = [(d, items.ids[m[0]], *m[1:]) for d, t in
                         zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                         for m in items.matches(t, least, words_least, common)]
                yield pa.RecordBatch.from_pylist([dict(zip(kinds, r)) for r in found],
                                                 pa.schema(kinds))

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, words_least: int = 20,
               common: int = 3, **options) -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark, filtered where they are."""
    for held in blocks(docs, benchmark, **options):
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for b in batches:
                clean = [not items.matches(t, least, words_least, common)
                         for t in b.column("text").to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir):
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
