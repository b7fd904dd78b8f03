"""Language identification with interpolated Kneser-Ney character models.

Texts become lower-case letters with single blanks between words. Spark counts the
4-letter sequences of every language over all training documents. Lower orders use the
number of distinct letters seen before a sequence, as Kneser-Ney smoothing asks, and all
orders are interpolated. Statistics and probabilities are group-bys and joins over all
counted sequences. The resulting weights sit in sorted arrays of 64-bit hashes with a list
of (language, weight) per sequence; an unknown sequence backs off to the next shorter one.
A text gets the language with the lowest cross-entropy per letter. A model of nine tenths
of the training documents tells, on the other tenth, which cross-entropies are usual for a
language; beyond that ``rejected`` is set and the score halved (the language is still
named, as only texts without any letter are ``und``). The model that predicts counts all.

Every counted sequence takes part. The model is broadcast in blocks of about ``block_rows``
rows by sequence; a task holds one at a time and adds up what each gives.

Defined cases
* null text, or text without a letter: ``und``, score 0.
* a null ``lang`` is not learned from; rows repeating a ``doc_id`` all count.
* equal cross-entropies: the language that sorts first.
* a very long text is looked up in pieces.
* without any training row every text is ``und`` with score 0.
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, documents, materialize

ORDER = 4
MASK16 = 0xFFFF
#: Letters encoded at once.
BLOCK = 1_000_000
#: Rows of the model that a task holds at most, about.
BLOCK_ROWS = 2_000_000


def _letter_table():
    """Code point -> itself for letters, blank otherwise; 16 bits."""
    import numpy as np
    ok = np.frompyfunc(lambda c: chr(c).isalpha(), 1, 1)(np.arange(0x10000)).astype(bool)
    return np.where(ok, np.arange(0x10000), 32).astype(np.uint64)


_LETTERS = None


def letters(text: str):
    """16-bit letter codes with single blanks, three blanks in front and one at the end;
    None if there is no letter. Letters beyond 16 bits are folded into them."""
    import numpy as np
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letter_table()
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = _LETTERS[cp & MASK16]
    big = cp > MASK16
    if big.any():
        wide = np.array([chr(x).isalpha() for x in cp[big]], bool)
        c[big] = np.where(wide, (cp[big].astype(np.uint64) * np.uint64(40503)) & np.uint64(MASK16)
                          | np.uint64(0x8000), np.uint64(32))
    blank = c == 32
    if blank.all():
        return None
    c = c[~(blank & np.concatenate([[True], blank[:-1]]))]
    return np.concatenate([np.full(ORDER - 1, 32, np.uint64), c, np.full(1, 32, np.uint64)])


def sequences(c):
    """The packed sequence of four letters that ends at each letter of a text."""
    import numpy as np
    a, b, d, e = c[:-3], c[1:-2], c[2:-1], c[3:]
    return a << np.uint64(48) | b << np.uint64(32) | d << np.uint64(16) | e


# ---- counting -----------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    for b in batches:
        by: dict[str, list] = {}
        held: dict[str, int] = {}

        def flush(lang):
            keys, n = np.unique(np.concatenate(by.pop(lang)), return_counts=True)
            held.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)],
                ["lang", "seq", "n"])

        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            c = letters(text)
            if c is None:
                continue
            by.setdefault(lang, []).append(sequences(c))
            held[lang] = held.get(lang, 0) + len(c)
            if held[lang] > BLOCK:
                yield flush(lang)
        for lang in list(by):
            yield flush(lang)


def counts(train: DataFrame) -> DataFrame:
    """(lang, seq, n) over all rows of (lang, text)."""
    return (train.mapInArrow(_count, "lang string, seq long, n long")
            .groupBy("lang", "seq").agg(F.sum("n").alias("n")))


# ---- the model ----------------------------------------------------------------------


def _hash(keys, order: int):
    """64-bit mix of a packed sequence and its length."""
    import numpy as np
    x = keys + np.uint64(order * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class HashArray:
    """Rows of values by hash: sorted hashes, and where each prefix begins."""

    def __init__(self, keys, order: int, values):
        import numpy as np
        h = _hash(keys, order)
        at = np.argsort(h, kind="stable")
        self.hash, self.values, self.order = h[at], values[at], order
        bits = max(1, int(len(h)).bit_length())
        self.shift = np.uint64(64 - bits)
        first = np.searchsorted(self.hash >> self.shift, np.arange(2**bits + 1, dtype=np.uint64))
        self.first = first.astype(np.int64)
        self.longest = int((self.first[1:] - self.first[:-1]).max()) if len(h) else 0

    def find(self, keys):
        """Row of each key, or -1."""
        import numpy as np
        h = _hash(keys, self.order)
        p = (h >> self.shift).astype(np.int64)
        at, end = self.first[p], self.first[p + 1]
        out = np.full(len(keys), -1, np.int64)
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        for _ in range(self.longest):
            hit = self.hash[at] == h
            out[todo[hit]] = at[hit]
            at = at + 1
            left = ~hit & (at < end)
            if not left.any():
                break
            todo, at, end, h = todo[left], at[left], end[left], h[left]
        return out


class KneserNey:
    """Interpolated Kneser-Ney model of all languages, from counts in memory: what
    :func:`weights` is compared with.

    ``prob[n]``: log probabilities of the known sequences of n letters, one column per
    language; ``back[n]``: log weights that a context of n letters leaves to the model of
    the next lower order.
    """

    def __init__(self, langs: list[str], lang_index, seqs, n):
        import numpy as np
        self.langs, L = langs, len(langs)
        keys, row = np.unique(seqs, return_inverse=True)
        c = np.zeros((len(keys), L))
        np.add.at(c, (row, lang_index), n)
        grams = {ORDER: (keys, c)}
        for order in range(ORDER - 1, 0, -1):  # distinct letters before each shorter sequence
            k, cc = grams[order + 1]
            short, at = np.unique(k & np.uint64(2 ** (16 * order) - 1), return_inverse=True)
            types = np.zeros((len(short), L))
            np.add.at(types, at, cc > 0)
            grams[order] = (short, types)
        self.floor = -np.log(len(grams[1][0]) + 1.0)
        self.prob, self.back = {}, {}
        low_keys, low = None, None
        for order in range(1, ORDER + 1):
            k, cc = grams[order]
            ctx, at = np.unique(k >> np.uint64(16), return_inverse=True)
            total, kinds = np.zeros((len(ctx), L)), np.zeros((len(ctx), L))
            np.add.at(total, at, cc)
            np.add.at(kinds, at, cc > 0)
            ones, twos = (cc == 1).sum(axis=0), (cc == 2).sum(axis=0)
            cut = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
            bow = np.where(total > 0, cut * kinds / np.maximum(total, 1e-9), 1.0)
            if order == 1:
                below = np.full((len(k), L), np.exp(self.floor))
            else:
                below = low[np.searchsorted(low_keys, k & np.uint64(2 ** (16 * (order - 1)) - 1))]
            p = np.maximum(cc - cut, 0) / np.maximum(total[at], 1e-9) + bow[at] * below
            self.prob[order] = HashArray(k, order, np.log(p).astype(np.float32))
            self.back[order - 1] = HashArray(ctx, order - 1, np.log(bow).astype(np.float32))
            low_keys, low = k, p

    def log_probs(self, keys, order: int = ORDER):
        """Log probability of each sequence's last letter after the others, per language."""
        import numpy as np
        if order == 0:
            return np.full((len(keys), len(self.langs)), self.floor, np.float32)
        at = self.prob[order].find(keys)
        out = self.prob[order].values[np.maximum(at, 0)]
        lost = np.flatnonzero(at < 0)
        if len(lost):
            k = keys[lost]
            ctx = self.back[order - 1].find(k >> np.uint64(16))
            bow = np.where((ctx >= 0)[:, None], self.back[order - 1].values[np.maximum(ctx, 0)], 0)
            out[lost] = bow + self.log_probs(k & np.uint64(2 ** (16 * (order - 1)) - 1), order - 1)
        return out


# ---- the same model for tables of any size ------------------------------------------

PROB, BACK = 0, 1


def _suffix(order: int):
    return F.col("seq").bitwiseAND(F.lit(2 ** (16 * order) - 1))


def weights(table: DataFrame) -> DataFrame:
    """(kind, seq, lang, w) of the model of ``table`` (lang, seq, n), lang a number.

    A letter's log probability is a sum: for every known sequence that ends at it, its log
    probability less what backing off would give (``PROB``), and for every known context
    before it, the log weight of backing off (``BACK``). A sequence that a language has not
    seen adds nothing for it, so there is one row for each that it has. Sequences of
    different lengths are different numbers, as no letter is 0.
    """
    alphabet = table.agg(F.count_distinct(_suffix(1))).first()[0]
    grams = {ORDER: table}
    for order in range(ORDER - 1, 0, -1):  # distinct letters before each shorter sequence
        grams[order] = materialize(grams[order + 1].groupBy("lang", _suffix(order).alias("seq"))
                                   .agg(F.count(F.lit(1)).alias("n")), "kn-grams")
    parts, low = [], None
    for order in range(1, ORDER + 1):
        g = grams[order].withColumn("ctx", F.shiftrightunsigned("seq", 16))
        ones, twos = F.count_if(F.expr("n = 1")), F.count_if(F.expr("n = 2"))
        cuts = g.groupBy("lang").agg(F.least(F.greatest(
            ones / F.greatest(ones + 2 * twos, F.lit(1)), F.lit(0.1)), F.lit(0.95)).alias("cut"))
        ctx = g.groupBy("lang", "ctx").agg(F.sum("n").alias("total"),
                                           F.count(F.lit(1)).alias("kinds"))
        ctx = ctx.join(F.broadcast(cuts), "lang").withColumn(
            "bow", F.expr("cut * kinds / total"))  # cuts: a row per language
        if order == 1:  # one context, the empty one
            g = g.join(F.broadcast(ctx), ["lang", "ctx"]).withColumn(
                "below", F.lit(1.0 / (alphabet + 1)))
        else:
            g = g.join(ctx, ["lang", "ctx"]).withColumn("low", _suffix(order - 1))
            g = g.join(low.select("lang", F.col("seq").alias("low"), F.col("p").alias("below")),
                       ["lang", "low"])
        low = materialize(g.select("lang", "seq", F.expr(
            "greatest(n - cut, 0D) / total + bow * below").alias("p"),
            F.expr("bow * below").alias("without")), "kn-probs")
        parts.append(low.select(F.lit(PROB).alias("kind"), "seq", "lang",
                                F.expr("ln(p / without)").alias("w")))
        parts.append(ctx.select(F.lit(BACK).alias("kind"), F.col("ctx").alias("seq"), "lang",
                                F.log("bow").alias("w")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Block:
    """A part of the rows of :func:`weights`, looked up by kind and sequence."""

    def __init__(self, kind, seq, lang, w):
        import numpy as np
        at = np.lexsort((seq, kind))
        kind, seq, self.lang, self.w = kind[at], seq[at], lang[at], w[at].astype(np.float32)
        first = np.flatnonzero(np.concatenate(
            [[True], (seq[1:] != seq[:-1]) | (kind[1:] != kind[:-1])])[:len(seq)])
        ends = np.stack([first, np.append(first[1:], len(seq))], axis=1)
        self.rows = {k: HashArray(seq[first][own], k, ends[own])
                     for k in (PROB, BACK) for own in [kind[first] == k]}

    def add(self, out, keys, kind: int) -> None:
        """Adds each key's weights to its row of ``out``."""
        import numpy as np
        found = self.rows[kind]
        at = found.find(keys) if len(found.hash) else np.full(len(keys), -1)
        hit = np.flatnonzero(at >= 0)
        if not len(hit):
            return
        start, end = found.values[at[hit]].T
        n = end - start
        row = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
        out[np.repeat(hit, n), self.lang[row]] += self.w[row]


class Model:
    """Languages and broadcast blocks of their weights. A sequence's rows are in the block
    that the sequence modulo the number of blocks names; a task holds one block at a time."""

    def __init__(self, langs: list[str], floor: float, blocks: list):
        self.langs, self.floor, self.blocks = langs, floor, blocks
        self.usual: dict[str, tuple[float, float]] = {}

    def log_probs(self, keys):
        """Log probability of each sequence's last letter after the others, per language."""
        import numpy as np
        low = [keys & np.uint64(2 ** (16 * n) - 1) for n in range(1, ORDER)]
        before = keys >> np.uint64(16)
        looked = [(PROB, k) for k in (keys, *low)] + [(BACK, before)] + [
            (BACK, before & np.uint64(2 ** (16 * n) - 1)) for n in range(ORDER - 1)]
        out = np.full((len(keys), len(self.langs)), self.floor)
        for i, block in enumerate(self.blocks):
            for kind, k in looked:
                if len(self.blocks) == 1:
                    block.value.add(out, k, kind)
                    continue
                own = np.flatnonzero(k.view(np.int64) % len(self.blocks) == i)
                part = np.zeros((len(own), out.shape[1]))
                block.value.add(part, k[own], kind)
                out[own] += part
            if len(self.blocks) > 1:
                block.__dict__.pop("_value", None)  # read again from the executor's file
        return out

    def best(self, texts):
        """(language, cross-entropy, score, rejected) of each text, None without a letter.
        Texts are looked up together, and long ones in pieces, a block of letters at a time."""
        import numpy as np
        block = max(1000, min(BLOCK, 4 * BLOCK // len(self.langs)))
        total = np.zeros((len(texts), len(self.langs)))
        size = np.zeros(len(texts), np.int64)
        part: list[tuple] = []
        held = 0

        def look_up():
            keys, row = np.unique(np.concatenate([s for _, s in part]), return_inverse=True)
            starts = np.cumsum([0] + [len(s) for _, s in part[:-1]])
            sums = np.add.reduceat(self.log_probs(keys)[row], starts, axis=0)
            np.add.at(total, [i for i, _ in part], sums)

        for i, t in enumerate(texts):
            c = None if t is None else letters(t)
            if c is None:
                continue
            seqs = sequences(c)
            size[i] = len(seqs)
            for at in range(0, len(seqs), block):
                piece = seqs[at:at + block]
                if part and held + len(piece) > block:
                    look_up()
                    part, held = [], 0
                part.append((i, piece))
                held += len(piece)
        if part:
            look_up()
        return [self._judge(-total[i] / n, n) if n else None for i, n in enumerate(size)]

    def _judge(self, h, n):
        import numpy as np
        n += ORDER - 1  # letters with the blanks in front
        k = int(np.argmin(h))
        score = 1 / np.exp(-min(n, 50) * (h - h[k])).sum()
        mean, dev = self.usual.get(self.langs[k], (None, None))
        odd = mean is not None and h[k] > mean + 4 * dev + 3 / n
        return self.langs[k], float(h[k]), float(score) * (0.5 if odd else 1.0), bool(odd)


def fit(table: DataFrame, block_rows: int = BLOCK_ROWS) -> Model | None:
    """The model of all rows of ``table`` (lang, seq, n)."""
    import numpy as np
    spark = table.sparkSession
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    if not langs:
        return None
    number = spark.createDataFrame(list(enumerate(langs)), "no int, lang string")
    table = materialize(table.join(F.broadcast(number), "lang").select(
        F.col("no").alias("lang"), "seq", "n"), "kn-grams")
    alphabet = table.agg(F.count_distinct(_suffix(1))).first()[0]
    rows = materialize(weights(table), "kn-weights")
    many = rows.count()
    n = 1 if many <= block_rows else 2 * (many // block_rows) + 1
    if n > 1:  # a block's rows lie together, so that reading one skips the others
        rows = materialize(rows.withColumn("block", F.pmod("seq", F.lit(n)))
                           .repartitionByRange("block", "seq").sortWithinPartitions("block"),
                           "kn-blocks")
    blocks = []
    for i in range(n):
        got = (rows.where(F.col("block") == i) if n > 1 else rows).toArrow()
        blocks.append(spark.sparkContext.broadcast(Block(
            got.column("kind").to_numpy(), got.column("seq").to_numpy().view(np.uint64),
            got.column("lang").to_numpy(), got.column("w").to_numpy())))
    return Model(langs, -np.log(alphabet + 1.0), blocks)


def train(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> Model | None:
    """The model of all documents (doc_id, text, lang). The usual cross-entropies are those
    that a model of nine tenths gives to the other tenth, so they are of unseen texts; the
    model itself counts both. A language that only the tenth holds has no usual value, and
    none of its texts is rejected."""
    rows = docs.where("text is not null and lang is not null").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        (F.floor(crc_fold("doc_id", 30) / 3) == 0).alias("check"))
    most = materialize(counts(rows.where("not check")), "kn-counts")
    rest = counts(rows.where("check"))
    both = most.unionByName(rest).groupBy("lang", "seq").agg(F.sum("n").alias("n"))
    model, usual = fit(most, block_rows), {}
    if model is not None:
        usual = usual_entropies(rows.where("check").select("text", "lang"), model)
        for block in model.blocks:  # its part is done: free the driver's copy as well
            block.destroy()
        del model
    model = fit(materialize(both, "kn-counts"), block_rows)
    if model is not None:
        model.usual = usual
    return model


def usual_entropies(rows: DataFrame, model: Model) -> dict[str, tuple[float, float]]:
    """Mean and deviation of the cross-entropy of each language's rightly named texts."""
    def usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [(x[0], x[1]) for x, l in zip(model.best(b.column("text").to_pylist()),
                                              b.column("lang").to_pylist()) if x and x[0] == l]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ok], pa.string()),
                                              pa.array([x[1] for x in ok], pa.float64())],
                                             ["lang", "h"])

    found = (rows.mapInArrow(usual, "lang string, h double")
             .groupBy("lang").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s")).collect())
    return {r["lang"]: (r["m"], max(r["s"], 0.05)) for r in found}


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected, one row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            got = model.best(texts) if model else [None] * len(texts)
            got = [x or ("und", None, 0.0, True) for x in got]
            cols = list(zip(*got)) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(
                    cols, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]],
                ["doc_id", "lang_pred", "entropy", "score", "rejected"])

    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("text").cast("string").alias("text"))
    return t.mapInArrow(run, "doc_id long, lang_pred string, entropy double, score double, "
                             "rejected boolean")


def op7_language(spark, sf_dir):
    """The language of all ``documents``, learned from two thirds of them."""
    docs = documents(spark, sf_dir)
    fold = crc_fold("doc_id", 3)
    p = predict(docs, train(docs.where(fold != 1)))
    return p.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "rejected")
