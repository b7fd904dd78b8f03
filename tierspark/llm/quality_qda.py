"""Quality classifier: regularised quadratic discriminant over document statistics.

One pass turns every whole text into a short vector of statistics (logarithms of shares,
so that ratios count alike at every level). Means and covariances per class are sums of
x and x x' over all labelled training rows, added up by Spark. Each class covariance is
shrunk towards the pooled one and that towards a multiple of the identity; its Cholesky
factor is computed once and ships with the scoring task, where it gives Mahalanobis
distances and log densities. A logistic curve fitted to a histogram of the training
rows' log-density differences turns the difference into a score between 0 and 1.

Defined cases
* null text counts as empty; empty texts have their own (constant) statistics and a score.
* labels that are null, or whose document is missing, are not learned from; a label given
  several times alike counts once, contradicting labels all count.
* rows repeating a ``doc_id`` are all scored and, if labelled, all learned from.
* without training rows of both classes the score is the share of class 1 (0.5 if none).
* an empty table gives an empty result; extra columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, documents, materialize, whole_text

#: Bytes of a block for the statistics of a text's worst part.
BLOCK = 256
FLOOR = 1e-4
STATS = ["bytes", "words", "word_length", "upper", "symbol", "bar", "bang", "digit", "stop",
         "beyond_ascii", "line", "distinct", "repeat", "block_symbol", "block_upper",
         "block_blank"]


def _classes():
    """Byte -> 0 other, 1 A-Z, 2 symbol, 3 bar, 4 bang, 5 digit, 6 . , ; :, 7 above ASCII,
    8 newline, 9 other blank."""
    import numpy as np
    t = np.zeros(256, np.uint8)
    for chars, c in ((range(65, 91), 1), (b"#$%&*@~^<>{}[]=_+\\/`", 2), (b"|", 3), (b"!?", 4),
                     (b"0123456789", 5), (b".,;:", 6), (range(128, 256), 7), (b"\n", 8),
                     (b" \t\x0b\x0c\r", 9)):
        t[list(chars)] = c
    return t


def _word_stats(text: bytes):
    from operator import eq
    words = text.split()
    n = len(words)
    if not n:
        return 0, 1.0, 0.0
    return n, len(set(words)) / n, sum(map(eq, words[1:], words)) / n


def vectors(texts: list[bytes]):
    """Matrix of the statistics, one row per text."""
    import numpy as np
    table, k = _classes(), 10
    size = np.array([len(t) for t in texts], np.int64)
    counts = np.zeros((len(texts), k))
    worst = np.zeros((len(texts), 3))
    words = np.array([_word_stats(t) for t in texts], float).reshape(len(texts), 3)
    for i, t in enumerate(texts):
        if not t:
            continue
        c = table[np.frombuffer(t, np.uint8)]
        counts[i] = np.bincount(c, minlength=k)
        if len(t) <= 2 * BLOCK:
            b = counts[i][None] / len(t)
        else:
            n = len(t) // BLOCK  # the last block also takes the rest
            at = np.minimum(np.arange(len(t)) // BLOCK, n - 1)
            b = np.bincount(at * k + c, minlength=n * k).reshape(n, k)
            b = b / b.sum(axis=1, keepdims=True)
        worst[i] = [(b[:, 2] + b[:, 3] + b[:, 4]).max(), b[:, 1].max(), b[:, 9].max()]
    share = counts / np.maximum(size, 1)[:, None]
    log = lambda x: np.log(x + FLOOR)
    n = words[:, 0]
    cols = [np.log1p(size), np.log1p(n), np.log1p(size / np.maximum(n, 1)), log(share[:, 1]),
            log(share[:, 2]), log(share[:, 3]), log(share[:, 4]), log(share[:, 5]),
            log(share[:, 6]), log(share[:, 7]), log(share[:, 8]), log(words[:, 1]),
            log(words[:, 2]), log(worst[:, 0]), log(worst[:, 1]), log(worst[:, 2])]
    return np.stack(cols, axis=1) if len(texts) else np.zeros((0, len(STATS)))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x.as_buffer().to_pybytes() for x in b.column("t").cast(pa.large_binary())]
        x = vectors(texts)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its whole text."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"))
    return t.mapInArrow(_statistics, "doc_id long, x array<double>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, i, j, v) of one partition: the sums of z z' with z = (1, x)."""
    import numpy as np
    total: dict[int, np.ndarray] = {}
    for b in batches:
        y = np.array(b.column("y").to_pylist(), int)
        x = np.array(b.column("x").to_pylist(), float).reshape(len(y), -1)
        z = np.hstack([np.ones((len(y), 1)), x])
        for c in np.unique(y):
            total[int(c)] = total.get(int(c), 0) + z[y == c].T @ z[y == c]
    for c, s in total.items():
        i, j = np.triu_indices(len(s))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), c)), pa.array(i), pa.array(j), pa.array(s[i, j])],
            ["y", "i", "j", "v"])


class Discriminant:
    """Class means and Cholesky factors of the shrunken covariances."""

    def __init__(self, sums: dict, to_pooled: float = 0.1, to_identity: float = 0.001):
        import numpy as np
        self.prior = {c: float(s[0, 0]) for c, s in sums.items()}
        self.mean, scatter = {}, {}
        for c, s in sums.items():
            self.mean[c] = s[0, 1:] / s[0, 0]
            scatter[c] = s[1:, 1:] - s[0, 0] * np.outer(self.mean[c], self.mean[c])
        n = sum(self.prior.values())
        pooled = sum(scatter.values()) / n
        d = len(pooled)
        self.factor, self.log_det = {}, {}
        for c in sums:
            cov = (1 - to_pooled) * scatter[c] / self.prior[c] + to_pooled * pooled
            ridge = max(np.trace(cov) / d, 1e-6)
            cov = (1 - to_identity) * cov + to_identity * ridge * np.eye(d)
            self.factor[c] = np.linalg.cholesky(cov)
            self.log_det[c] = 2 * np.log(np.diag(self.factor[c])).sum()
        self.slope, self.shift = 1.0, 0.0

    def difference(self, x):
        """Log density of class 1 minus that of class 0, on a compressed scale."""
        import numpy as np
        out = 0.0
        for c, sign in ((1, 0.5), (0, -0.5)):
            u = np.linalg.solve(self.factor[c], (x - self.mean[c]).T)
            out = out - sign * ((u * u).sum(axis=0) + self.log_det[c])
        return np.arcsinh(out)

    def score(self, x):
        import numpy as np
        z = np.clip(self.slope * self.difference(x) + self.shift, -35, 35)
        return 1 / (1 + np.exp(-z))


def _fit_curve(bins: list[tuple[float, int, int]], rounds: int = 50) -> tuple[float, float]:
    """Logistic curve through (difference, class, rows), by damped Newton steps."""
    import numpy as np
    v, y, w = (np.array(c, float) for c in zip(*bins))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -35, 35)))
        g = np.array([(w * (y - p) * v).sum() - 0.01 * a, (w * (y - p)).sum()])
        q = w * p * (1 - p)
        h = np.array([[(q * v * v).sum() + 0.01, (q * v).sum()], [(q * v).sum(), q.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
    return max(float(a), 1e-3), float(b)


def fit(stats: DataFrame, labels: DataFrame, fold: int = 5, out_fold: int = 0):
    """The model from the labelled rows whose fold isn't ``out_fold`` (None: too few)."""
    import numpy as np
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("quality").cast("int").alias("y"))
         .where("y in (0, 1) and doc_id is not null").distinct())
    rows = stats.where(crc_fold("doc_id", fold) != out_fold).join(y, "doc_id").select("y", "x")
    rows = materialize(rows, "quality-train")
    got = (rows.mapInArrow(_sums, "y long, i long, j long, v double")
           .groupBy("y", "i", "j").agg(F.sum("v").alias("v")).collect())
    sums: dict[int, np.ndarray] = {}
    d = len(STATS) + 1
    for r in got:
        m = sums.setdefault(r["y"], np.zeros((d, d)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    if set(sums) != {0, 1} or min(m[0, 0] for m in sums.values()) < 2:
        n = {c: m[0, 0] for c, m in sums.items()}
        return None, (n.get(1, 0) / sum(n.values()) if n else 0.5)
    model = Discriminant(sums)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, -1)
            v = np.round(model.difference(x) * 50) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(v.astype(np.int64))],
                                             ["y", "bin"])

    bins = rows.mapInArrow(differences, "y int, bin long").groupBy("y", "bin").count().collect()
    model.slope, model.shift = _fit_curve([(r["bin"] / 50, r["y"], r["count"]) for r in bins])
    return model, None


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``."""
    import numpy as np
    stats = materialize(statistics(docs), "quality-stats")
    model, constant = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, -1)
            s = np.full(b.num_rows, constant) if model is None or not b.num_rows else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())],
                                             ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, filtered where they are."""
    model, constant = fit(materialize(statistics(docs), "quality-stats"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors([(t or "").encode("utf-8") for t in b.column("text").to_pylist()])
            good = [constant >= threshold] * b.num_rows if model is None else \
                (model.score(x) >= threshold).tolist()
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark, sf_dir):
    return scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


