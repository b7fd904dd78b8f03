"""Cross-tokenizer alignment with an identity map as fast path.

Both encodings of a text cover the same bytes (a blank and the text). Offsets where a
token of either ends cut them into groups; tokens with overlapping bytes are linked; an
id pair's count is the number of documents that hold it linked.

1. One pass encodes every whole text. Neither vocabulary has a token that holds a blank
   after another character, so a text falls apart before each blank that follows a
   non-blank, and its groups are those of its segments. Distinct segments are encoded and
   aligned once and kept (:class:`Segments`).
2. Fast path: ``identity`` maps an A id to the B id of the same bytes. Such pairs, as
   exact one-to-one groups and wherever else they are linked, are counted per A id in a
   vector as long as the vocabulary, one row of it a task. Only the other pairs, from
   irregular groups, enter the pair shuffle, counted per chunk of documents first.
3. Counts come back the same way: the vector, and the highest count of every A id, are
   arrays as long as the vocabulary and sent to all tasks; the counts of other pairs go to
   the chunks that asked for them, and are added up per document there.

A chunk is a run of documents of about ``CHUNK_LETTERS`` letters (one document, if that
is longer); nothing is gathered beyond a chunk, and a pair has one row per chunk however
frequent it is.

Defined results. Null and empty texts, and texts whose tokens do not give back their bytes
(letters that vocabulary B rewrites, U+2581): no tokens, zeros and ''. Names of special
tokens in a text are plain text. Repeated rows, and rows of equal or null id, are documents
of their own. Very long texts and very long segments are encoded whole. Ties for the
highest count all count as best. An empty table gives an empty result. Further columns
are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit_pack import in_parts
from .common import documents, materialize
from .vocab import BYTE_LEVEL, byte_letters, vocabulary

CHUNK_LETTERS, KEPT_SEGMENTS, KEPT_LENGTH = 2_000_000, 300_000, 64
BLANK = "▁"

#: A row is a document (its digests, and its pairs as positions in the chunk's list), a
#: chunk's list of irregular pairs, or a task's vector over the identity map.
SCHEMA = ("kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
          "groups_sha256 string, a array<int>, a_times array<int>, pair array<int>, "
          "pair_times array<int>, codes array<long>, docs array<long>")
DOCUMENT, LIST, VECTOR = 0, 1, 2


class Vocabularies:
    """Both vocabularies: their encoders, the bytes of every id and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        import json

        import numpy as np
        import sentencepiece
        import tiktoken
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = byte_letters()
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]["vocab"]
        a_bytes = {i: bytes(to_byte[c] for c in token) for token, i in model.items()
                   if all(c in to_byte for c in token)}
        self.a_bytes: list = [a_bytes.get(i, b"") for i in range(max(model.values()) + 1)]
        # ids follow the order of merges, so they are the ranks; special names are plain text
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, special_tokens={},
                                   mergeable_ranks={x: i for i, x in a_bytes.items()})
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace(BLANK, " ").encode()
                        for i in range(self.b.get_piece_size())]
        plain = [i for i in range(len(self.b_bytes))
                 if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i))]
        by_bytes = {}
        for i in sorted(plain, key=self.b.is_byte, reverse=True):  # a piece before a byte token
            by_bytes[self.b_bytes[i]] = i
        self.identity = np.array([by_bytes.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.blank = self.b.piece_to_id(BLANK)
        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64)
                                    for of in (self.a_bytes, self.b_bytes))

        a, b = (list(map(str, range(len(of)))) for of in (self.a_bytes, self.b_bytes))
        #: Ids as text with what may follow one: A a comma or bar, B a comma, ';' or line end.
        self.text = ([x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b]
                     + [x + ";" for x in b] + [x + "\n" for x in b])

    def encode_a(self, closed: list, open_: list, ends) -> tuple:
        """Ids of ' ' + word for all words, one after another, and how many of each. Closed
        words, whose bytes end at ``ends`` with their blanks, are encoded as one text; those
        that end in white space would run into the next blank."""
        import numpy as np
        joined = np.array(self.a.encode_ordinary(" " + " ".join(closed)) if closed else [], np.int64)
        at = np.searchsorted(np.cumsum(self.a_size[joined]), ends) + 1 if closed else []
        rest = [self.a.encode_ordinary(" " + w) for w in open_]
        return (np.concatenate([joined, np.array([x for own in rest for x in own], np.int64)]),
                np.concatenate([np.diff(at, prepend=0), np.array([len(own) for own in rest], np.int64)])
                .astype(np.int64))

    def encode_b(self, words: list) -> tuple:
        """Ids of ' ' + word: the model puts the blank before what it is given, but gives
        nothing for nothing."""
        import numpy as np
        ids = [own or [self.blank] for own in self.b.encode(words, num_threads=1)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


class Segments:
    """Aligned segments that a worker keeps, by the segment without its first blank. Arrays
    over all of them: whether the tokens give back the bytes, tokens of A and of B, groups,
    links, and where the links (codes a * size of B + b) begin; and the groups as text."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.clear()

    def clear(self) -> None:
        import numpy as np
        self.known: dict = {}
        self.text: list = []
        self.whole, self.sums, self.starts = (np.empty(0, bool), np.empty((0, 4), np.int64),
                                              np.empty(0, np.int64))
        self.codes = np.empty(0, np.int64)

    def learn(self, words: set) -> None:
        """Make all these segments known; the numbers of earlier ones may change."""
        import numpy as np
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_SEGMENTS:
            self.clear()
            new = list(words)
        if not new:
            return
        open_ = [w for w in new if not w or w[-1].isspace()]
        if open_:
            apart = set(open_)
            closed = [w for w in new if w not in apart]
            new = closed + open_
        else:
            closed = new
        v, n = self.v, len(new)
        raw = [(" " + w).encode() for w in new]
        size = np.fromiter(map(len, raw), np.int64, n)
        (a, n_a), (b, n_b) = v.encode_a(closed, open_, np.cumsum(size[:len(closed)])), v.encode_b(new)
        seg_a, seg_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        fits = (np.bincount(seg_a, v.a_size[a], n) == size) & (np.bincount(seg_b, v.b_size[b], n) == size)
        # where the lengths agree, the bytes are compared, of all such segments at once
        keep_a, keep_b = fits[seg_a], fits[seg_b]
        a_raw = b"".join(map(v.a_bytes.__getitem__, a[keep_a].tolist()))
        b_raw = b"".join(map(v.b_bytes.__getitem__, b[keep_b].tolist()))
        own = b"".join(r for r, ok in zip(raw, fits.tolist()) if ok)
        if a_raw != own or b_raw != own:
            at, text = np.repeat(np.flatnonzero(fits), size[fits]), np.frombuffer(own, np.uint8)
            for other in (a_raw, b_raw):
                fits[at[np.frombuffer(other, np.uint8) != text]] = False
            keep_a, keep_b = fits[seg_a], fits[seg_b]
        a, b, seg_a, seg_b = a[keep_a], b[keep_b], seg_a[keep_a], seg_b[keep_b]
        end_a, end_b = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b])
        start_a, start_b = end_a - v.a_size[a], end_b - v.b_size[b]
        first = np.searchsorted(end_b, start_a, "right")
        links = np.searchsorted(start_b, end_a, "left") - first     # tokens of B that each of A meets
        at = np.arange(int(links.sum())) + np.repeat(first - (np.cumsum(links) - links), links)
        codes = np.repeat(a, links) * len(v.b_bytes) + b[at]
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)     # also the ends of segments
        to_a, to_b = np.searchsorted(end_a, cuts) + 1, np.searchsorted(end_b, cuts) + 1
        group_seg = seg_a[to_a - 1] if len(cuts) else np.empty(0, np.int64)
        n_links = np.bincount(seg_a, links, n).astype(np.int64)
        n_groups = np.bincount(group_seg, minlength=n)
        sums = np.stack([np.where(fits, n_a, 0), np.where(fits, n_b, 0), n_groups, n_links], 1)
        base = len(self.text)
        texts = iter(self.group_texts(a, b, to_a, to_b, group_seg))
        self.text += [next(texts) if ok else "" for ok in fits.tolist()]
        self.known.update(zip(new, range(base, base + n)))
        self.starts = np.concatenate([self.starts, len(self.codes) + np.cumsum(n_links) - n_links])
        self.codes = np.concatenate([self.codes, codes])
        self.whole, self.sums = np.concatenate([self.whole, fits]), np.concatenate([self.sums, sums])

    def group_texts(self, a, b, to_a, to_b, group_seg) -> list:
        """The groups of each segment that has any, ``a1,a2|b1;a3|b2`` and so on."""
        import numpy as np
        if not len(to_a):
            return []
        from_a, from_b = (np.concatenate([[0], x[:-1]]) for x in (to_a, to_b))
        place_a = np.arange(len(a)) + np.repeat(from_b, to_a - from_a)
        place_b = np.arange(len(b)) + np.repeat(to_a, to_b - from_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[to_a - 1] = 1
        last_b[to_b - 1] = 1 + (np.diff(group_seg, append=-1) != 0)
        which = np.empty(len(a) + len(b), np.int64)
        n_a, n_b = len(self.v.a_bytes), len(self.v.b_bytes)
        which[place_a] = a + n_a * last_a
        which[place_b] = 2 * n_a + b + n_b * last_b
        return "".join(map(self.v.text.__getitem__, which.tolist())).split("\n")[:-1]


#: Before a blank that follows something else than white space; and any other blank.
CUT, OTHER = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


def segments_of(text: str) -> list:
    """The segments of ' ' + text without their first blanks."""
    if text[0] == " " or text[-1] == " " or OTHER.search(text):
        return [s[1:] for s in CUT.split(" " + text)]
    return text.split(" ")


class _Chunk:
    """Documents of one chunk, in arrays: what they return, and their linked pairs."""

    def __init__(self, segments: Segments, texts: list):
        import numpy as np
        split = [segments_of(t) if t else [] for t in texts]
        every = set().union(*split)
        segments.learn(every)
        counts = np.array([len(own) for own in split], np.int64)
        flat = np.fromiter(map(segments.known.__getitem__, itertools.chain.from_iterable(split)),
                           np.int64, int(counts.sum()))
        ends, n = np.cumsum(counts), len(split)
        doc = np.repeat(np.arange(n), counts)
        broken = np.bincount(doc, ~segments.whole[flat], n) > 0 if len(flat) else np.zeros(n, bool)
        get = segments.text.__getitem__
        self.digests = [
            "" if bad or a == b else hashlib.sha256(";".join(map(get, flat[a:b].tolist())).encode()).hexdigest()
            for bad, a, b in zip(broken.tolist(), (ends - counts).tolist(), ends.tolist())]
        good = ~broken[doc]
        doc, flat = doc[good], flat[good]
        self.sums = np.stack([np.bincount(doc, segments.sums[flat, c], n) for c in range(4)], 1).astype(np.int64)
        # each (document, segment) once, with its number of occurrences
        width = max(1, len(segments.text))
        key, times = np.unique(doc * width + flat, return_counts=True)
        doc, flat = key // width, key % width
        size = segments.sums[flat, 3]
        at = np.arange(int(size.sum())) + np.repeat(segments.starts[flat] - (np.cumsum(size) - size), size)
        #: all links: document, pair and number of occurrences
        self.doc, self.code, self.times = np.repeat(doc, size), segments.codes[at], np.repeat(times, size)
        for w in [w for w in every if len(w) > KEPT_LENGTH]:
            del segments.known[w]


def _distinct_links(chunk: _Chunk, keep) -> tuple:
    """Of the links that ``keep`` marks, each (document, pair) once, by document: documents,
    pairs and occurrences."""
    import numpy as np
    key, times = chunk.doc[keep] << 32 | chunk.code[keep], chunk.times[keep]   # a code has 31 bits
    order = np.argsort(key)
    key, times = key[order], times[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    key = key[at]
    return key >> 32, key & 0xFFFFFFFF, np.add.reduceat(times, at) if len(at) else times


_SEGMENTS: dict = {}


def linked_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Rows of ``SCHEMA`` from one pass over all texts."""
    a_path = a_path or vocabulary("byte_bpe_50k.json")
    b_path = b_path or vocabulary("piece_bpe_32k.model")

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        segments = _SEGMENTS.get((a_path, b_path))
        if segments is None:
            segments = _SEGMENTS[a_path, b_path] = Segments(Vocabularies(a_path, b_path))
        identity, size = segments.v.identity, len(segments.v.b_bytes)
        vector = np.zeros(len(identity), np.int64)
        number = TaskContext.get().partitionId() << 36
        kinds = [(c.split()[0], c.split()[1]) for c in SCHEMA.split(", ")]
        arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(),
                 "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}

        def rows(n, **columns):
            return pa.RecordBatch.from_arrays(
                [columns[c].cast(arrow[k]) if isinstance(columns.get(c), pa.Array)
                 else pa.array(columns.get(c, [None] * n), arrow[k]) for c, k in kinds],
                names=[c for c, _ in kinds])

        def lists(doc, values, n):
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_numpy(zero_copy_only=False).tolist()]
            for lo, hi in in_parts(texts, CHUNK_LETTERS):
                chunk, n = _Chunk(segments, texts[lo:hi]), hi - lo
                a = chunk.code // size
                same = identity[a] == chunk.code % size
                doc_1, code_1, times_1 = _distinct_links(chunk, same)
                doc_2, code_2, times_2 = _distinct_links(chunk, ~same)
                vector += np.bincount(code_1 // size, minlength=len(vector))
                codes, at = np.unique(code_2, return_inverse=True)
                yield rows(n, kind=[DOCUMENT] * n, chunk=[number] * n, doc_id=ids[lo:hi],
                           n_a=chunk.sums[:, 0], n_b=chunk.sums[:, 1], n_groups=chunk.sums[:, 2],
                           n_links=chunk.sums[:, 3], groups_sha256=chunk.digests,
                           a=lists(doc_1, code_1 // size, n), a_times=lists(doc_1, times_1, n),
                           pair=lists(doc_2, at, n), pair_times=lists(doc_2, times_2, n))
                if len(codes):
                    yield rows(1, kind=[LIST], chunk=[number], codes=[codes],
                               docs=[np.bincount(at, minlength=len(codes))])
                number += 1
        if vector.any():
            at = np.flatnonzero(vector)
            yield rows(1, kind=[VECTOR], codes=[at], docs=[vector[at]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(encode, SCHEMA)


def _pairs(linked: DataFrame, kind: int) -> DataFrame:
    """``chunk, at, code, docs`` of all lists of that kind."""
    return linked.where(F.col("kind") == kind).select(
        "chunk", F.posexplode(F.arrays_zip("codes", "docs")).alias("at", "x")).select(
        "chunk", "at", F.col("x.codes").alias("code"), F.col("x.docs").alias("docs"))


def pair_counts(linked: DataFrame, b_size: int) -> tuple:
    """(counts of the identity pairs by A id, counts of the irregular pairs): ``a, docs``
    and ``code, docs`` with code = a * b_size + b."""
    same = _pairs(linked, VECTOR).groupBy(F.col("code").alias("a")).agg(F.sum("docs").alias("docs"))
    other = _pairs(linked, LIST).groupBy("code").agg(F.sum("docs").alias("docs"))
    return same, other


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``."""
    spark = docs.sparkSession
    b_path = b_path or vocabulary("piece_bpe_32k.model")
    import numpy as np
    import sentencepiece
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    linked = materialize(linked_documents(docs, a_path, b_path), "linked")
    same, other = pair_counts(linked, b_size)
    other = materialize(other, "pair-counts")
    highest = other.groupBy(F.expr(f"code div {b_size}").alias("a")).agg(F.max("docs").alias("docs"))
    vectors = []
    for part in (same, highest):   # at most one row for each id of vocabulary A
        rows = part.collect()
        vector = np.zeros(1 + max([0, *(r["a"] for r in rows)]), np.int64)
        for r in rows:
            vector[r["a"]] = r["docs"]
        vectors.append(vector)
    n = max(map(len, vectors))
    by_same, by_other = (np.pad(v, (0, n - len(v))) for v in vectors)
    shared = spark.sparkContext.broadcast((by_same, np.maximum(by_same, by_other)))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def totals(key, own, counted):
        import pyarrow as pa
        same_count, top = shared.value
        counted = counted.sort_by("at")
        code = counted.column("code").to_numpy()
        count = counted.column("docs").to_numpy()
        best = count == top[code // b_size]

        def column(name):
            return own.column(name).combine_chunks()

        n_best = np.zeros(own.num_rows, np.int64)
        total = np.zeros(own.num_rows, np.int64)
        for where, times, value, hit in (("a", "a_times", same_count, same_count == top),
                                         ("pair", "pair_times", count, best)):
            at, many = column(where), column(times)
            doc = at.value_parent_indices().to_numpy()
            at, many = at.flatten().to_numpy(), many.flatten().to_numpy().astype(np.int64)
            if len(at):
                np.add.at(total, doc, many * value[at])
                np.add.at(n_best, doc, many * hit[at])
        return own.select(names[:5] + names[-1:]).append_column("n_best", pa.array(n_best)).append_column(
            "count_sum", pa.array(total)).select(names)

    asked = _pairs(linked, LIST).join(other.withColumnRenamed("docs", "all_docs"), "code").select(
        F.col("chunk").alias("asked_by"), "at", "code", F.col("all_docs").alias("docs"))
    return linked.where(F.col("kind") == DOCUMENT).select(
        "chunk", *names[:5], "groups_sha256", "a", "a_times", "pair", "pair_times").groupBy("chunk").cogroup(
        asked.groupBy("asked_by")).applyInArrow(totals, "doc_id long, n_a long, n_b long, n_groups long, "
                                             "n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment digests of every row of ``documents``. Nulls, empty and long texts, ties,
    repeated rows and an empty table: see the head of this module."""
    return align(documents(spark, sf_dir))
