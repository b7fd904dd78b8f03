"""Best-fit packing of documents into sequences by swap-based local search.

1. :func:`token_pieces` encodes every whole text, adds the end id and cuts only what is
   longer than a sequence. Each piece gets a number of its own, and the table is written
   once, so later steps see the same numbers when they are repeated.
2. Pieces as long as a sequence are sequences. The others are dealt by a hash of their
   number into groups of about ``group_size``; each group is packed by one call of
   :func:`pack_lengths`: best fit decreasing, then the local search. It moves a document
   from an underfull bin into another, exchanges one for one, two for one or one for two;
   every step takes tokens from an emptier bin into a fuller one, so the sum of squared
   fills grows, until the emptier bin is empty.
3. The bins that a group leaves less than seven eighths full are dealt into groups
   again and packed once more, until one group holds them all or a round saves no bin.

A sequence's number is the smallest number of its pieces.

Defined results. Null and empty texts: one piece holding the end id only. Very long
texts: cut into full pieces, the last may be shorter. Repeated rows, and rows with equal
or null ids, are packed each for itself. Equal lengths are taken in the order of the
pieces' numbers. An empty table gives an empty result. Further columns of the input are
not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize
from .vocab import WordIds, vocabulary

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, number long"


_WORD_IDS: dict = {}


def in_parts(texts: list, letters: int = 4_000_000):
    """Slices (from, to) of a list of texts, of about so many letters or one text each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= letters:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                 end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``): ``doc_id, piece, start, length,
    ids_crc32, number`` and, on request, ``ids``. Not yet written anywhere: ``number`` is
    fixed once the frame is."""
    path = path or vocabulary("word_bpe_49k.json")

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        words = _WORD_IDS.get(path)
        if words is None:
            words = _WORD_IDS[path] = WordIds(path)
        end = np.array([] if end_id is None else [end_id], "<u4")
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_numpy(zero_copy_only=False).tolist()]
            for lo, hi in in_parts(texts):
                tokens, ends = words.of(texts[lo:hi])
                rows = []
                for doc, a, b in zip(ids[lo:hi], ends.tolist(), ends.tolist()[1:]):
                    got = np.concatenate([tokens[a:b], end])
                    for k in range(0, max(1, len(got)), capacity):
                        cut = got[k:k + capacity]
                        rows.append((doc, k // capacity, k, len(cut), zlib.crc32(cut.tobytes()),
                                     number) + (cut.astype("int32"),) * with_ids)
                        number += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                         pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = PIECES + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)


def best_fit_decreasing(lengths, capacity: int) -> list:
    """Bins as lists of positions: longest first, each into the bin with the least room
    that holds it. Bit r of ``rooms`` says whether a bin with room r exists."""
    import numpy as np
    bins, by_room, rooms = [], {}, 0
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins


class _Underfull:
    """The underfull bins of a group during the local search: for each the lengths it
    can give back, none, one or two at a time, in flat arrays over all bins. A bin keeps
    its place in them as long as its lengths fit there."""

    def __init__(self, bins: dict, lengths, capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = {b: sum(lengths[i] for i in own) for b, own in bins.items()}
        self.back = {b: self.sums(b) for b in bins}
        self.looks, self.at = 0, None

    def place(self, b: int) -> None:
        """Write what bin b can give back into the arrays; all anew if it has no room."""
        import numpy as np
        if self.at is None or len(self.back[b][0]) + len(self.back[b][1]) + 1 > self.slot[b][1]:
            at, start = [], 0
            self.slot = {}
            for c, (one, two) in self.back.items():
                n = 1 + len(one) + len(two)
                self.slot[c] = (start, n + 4)
                at.append(np.full(n + 4, c))
                start += n + 4
            self.at = np.concatenate(at)
            self.size, self.parts = np.empty(start, np.int64), np.empty(start, np.int64)
            self.of_fill = np.zeros(int(self.at.max()) + 1, np.int64)
            todo = list(self.back)
        else:
            todo = [b]
        for c in todo:
            (start, room), (one, two) = self.slot[c], self.back[c]
            self.size[start:start + room], self.parts[start:start + room] = -1, 3
            n = start + 1 + len(one)
            self.size[start], self.parts[start] = 0, 0
            self.size[start + 1:n], self.parts[start + 1:n] = one, 1
            self.size[n:n + len(two)], self.parts[n:n + len(two)] = two, 2
            self.of_fill[c] = self.fill[c]

    def sums(self, b: int) -> tuple:
        """Distinct lengths of bin b, and distinct sums of two of them."""
        import numpy as np
        own = np.sort(np.fromiter((self.lengths[i] for i in self.bins[b]), np.int64))
        i, j = np.triu_indices(len(own), 1)
        return np.unique(own), np.unique(own[i] + own[j])

    def pick(self, b: int, total: int, parts: int) -> list:
        """That many documents of bin b of that total length."""
        if parts == 0:
            return []
        seen: dict = {}
        for i in self.bins[b]:
            n = self.lengths[i]
            if parts == 1 and n == total:
                return [i]
            if parts == 2 and total - n in seen:
                return [seen[total - n], i]
            seen.setdefault(n, i)
        raise AssertionError("no documents of that length")

    def best_step(self, s: int):
        """The step out of bin s into a bin at least as full that raises the sum of
        squared fills most: (gain, given, its parts, bin, given back, its parts)."""
        import numpy as np
        if self.at is None:
            self.place(s)
        self.looks += 1
        fill, own = self.of_fill[self.at], self.fill[s]
        use = np.flatnonzero((fill >= own) & (fill < self.capacity) & (self.at != s) & (self.parts < 3))
        size, parts, fill, best = self.size[use], self.parts[use], fill[use], None
        for given, n in [(g, 1) for g in self.back[s][0]] + [(g, 2) for g in self.back[s][1]]:
            d = given - size
            fits = (d > 0) & (d <= self.capacity - fill)
            if n == 2:
                fits &= parts == 1
            gain = np.where(fits, d * (fill - own + d), 0)
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] and (best is None or gain[k] > best[0]):
                best = (int(gain[k]), int(given), n, int(self.at[use[k]]), int(size[k]), int(parts[k]))
        return best

    def empty(self, s: int) -> bool:
        """Take steps out of bin s until it is empty (true) or no step is left."""
        while True:
            step = self.best_step(s)
            if step is None:
                return False
            _, given, n, t, back, m = step
            out, in_ = self.pick(s, given, n), self.pick(t, back, m)
            for i in out:
                self.bins[s].remove(i)
            for i in in_:
                self.bins[t].remove(i)
            self.bins[s] += in_
            self.bins[t] += out
            self.fill[s] -= given - back
            self.fill[t] += given - back
            for b in (s, t):
                self.back[b] = self.sums(b)
                self.place(b)
            if not self.bins[s]:
                self.of_fill[s] = self.capacity     # takes no part any more
                del self.bins[s], self.fill[s], self.back[s]
                return True


def fewest_bins(lengths, capacity: int) -> int:
    """A number of bins that no packing can do without. For each length k up to half a bin:
    documents longer than half a bin need bins of their own, and those of k to half a bin
    need what room the former leave, except beside documents longer than capacity - k."""
    import numpy as np
    count = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    alone = number[capacity] - number[capacity - k]
    beside = number[capacity - k] - number[half]
    room = beside * capacity - (total[capacity - k] - total[half])
    more = -(-np.maximum(0, small - room) // capacity)
    return int(max(-(-int(total[-1]) // capacity), (alone + beside + more).max()))


def pack_lengths(lengths, capacity: int, effort: float = 2.0) -> list:
    """Bins (lists of positions) for lengths of at most ``capacity``: best fit decreasing,
    then the local search out of the underfull bins, the emptiest first. It ends when no
    packing can have fewer bins, when no step is left, or when it has looked for a step
    ``effort`` times for each document; all documents are packed in any case."""
    lengths = [int(n) for n in lengths]
    bins = dict(enumerate(best_fit_decreasing(lengths, capacity)))
    least = fewest_bins(lengths, capacity)
    if len(bins) > least:
        under = _Underfull({b: own for b, own in bins.items()
                            if sum(lengths[i] for i in own) < capacity}, lengths, capacity)
        looks, moved = effort * len(lengths), True
        while moved and len(bins) > least and under.looks < looks:
            moved = False
            for s in sorted(under.bins, key=lambda b: (under.fill[b], b)):
                if len(bins) > least and under.looks < looks and under.fill[s] < capacity:
                    before = under.fill[s]
                    if under.empty(s):
                        del bins[s]
                        moved = True
                    else:
                        moved |= under.fill[s] < before
    return list(bins.values())


def _pack_groups(pieces: DataFrame, groups: int, capacity: int, open_below: float) -> DataFrame:
    """The pieces with ``sequence_id``, ``offset`` and whether their bin stays ``open``,
    packed in so many groups dealt by a hash of ``number``."""
    names = pieces.columns

    def pack(table):
        import numpy as np
        import pyarrow as pa
        table = table.sort_by("number")
        length, number = (table.column(c).to_numpy() for c in ("length", "number"))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        unfinished = np.empty(len(length), bool)
        for own in pack_lengths(length, capacity):
            own = np.sort(np.array(own))
            total = np.cumsum(length[own])
            sequence[own], offset[own] = number[own[0]], total - length[own]
            unfinished[own] = total[-1] < open_below * capacity
        out = table.select(names)
        for name, values in (("sequence_id", sequence), ("offset", offset), ("open", unfinished)):
            out = out.append_column(name, pa.array(values))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.groupBy(F.pmod(F.xxhash64("number"), F.lit(groups)).alias("own_group")).applyInArrow(
        lambda key, table: pack(table), schema + ", sequence_id long, offset long, open boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = 8192,
         open_below: float = 0.875) -> DataFrame:
    """Pieces (a written table with ``number``, unique, and ``length``, at most
    ``capacity``) with ``sequence_id`` and ``offset``; all other columns stay."""
    names = pieces.columns + ["sequence_id", "offset"]
    parts = [pieces.where(F.col("length") >= capacity).select(
        "*", F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, bins = pieces.where(F.col("length") < capacity), None
    while True:
        n = rest.count()
        groups = max(1, -(-n // group_size))
        packed = materialize(_pack_groups(rest.select(pieces.columns), groups, capacity, open_below),
                             "packed")
        left = packed.where("open")
        left_bins = left.where("offset = 0").count() if groups > 1 else 0
        if groups == 1 or left_bins == 0 or (bins is not None and left_bins >= bins):
            parts.append(packed.select(names))
            break
        parts.append(packed.where("NOT open").select(names))
        rest, bins = left, left_bins
    out = parts[0].select(names)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all ``documents`` in sequences of 2048 tokens. Nulls, empty and long
    texts, ties, repeated rows and an empty table: see the head of this module."""
    pieces = materialize(token_pieces(documents(spark, sf_dir)), "pieces")
    return pack(pieces).drop("number")
