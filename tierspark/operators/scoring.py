"""Cluster scoring and classification against the category rules.

Scores are column expressions over a table with one row per cluster and one
median column per feature; the rule set (a handful of constants) enters as
literals, so no rule table is joined. For every category the score is a sum,
in the fixed feature order, of

* the Moderate category: ``w * f(1 - |delta|)`` when ``|delta| < band``;
* other categories: ``w * f(|delta|)`` when the direction is 0 or
  ``sign(delta)`` equals it,

with ``delta = median - global_median`` and ``f(x) = x^2`` (replaceable). A NULL
median (empty cluster) contributes 0. The best category has the highest
score, then the highest replication factor, then the earliest category order.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tierspark.functions.vectors import qcol
from tierspark.operators.median import exact_medians
from tierspark.schemas import DEFAULT_RULES, Rules
from tierspark.session import release


def square(x: Column) -> Column:
    """Default deviation weight f(x) = x^2."""
    return x * x


def score_expr(rules: Rules, category: str, median_col: Mapping[str, str] | None = None,
               f: Callable[[Column], Column] = square) -> Column:
    """The score of ``category``, terms summed left to right in feature order."""
    total = None
    for p in rules.features:
        median = F.col(f"`{median_col[p]}`" if median_col else f"`{p}`")
        delta = median - F.lit(float(rules.global_medians[p]))
        weight = F.lit(float(rules.weights[category][p]))
        direction = rules.directions[category][p]
        if category == rules.moderate:
            term = F.when(F.abs(delta) < F.lit(float(rules.moderate_band)),
                          weight * f(F.lit(1.0) - F.abs(delta)))
        elif direction == 0:
            term = weight * f(F.abs(delta))
        else:
            term = F.when(F.signum(delta) == F.lit(float(direction)), weight * f(F.abs(delta)))
        term = F.coalesce(term, F.lit(0.0))
        total = term if total is None else total + term
    return total


def cluster_medians(labeled: DataFrame, cols: Sequence[str], k: int,
                    cluster_col: str = "cluster", **kw) -> DataFrame:
    """Exact median of every feature for each cluster 0..k-1 (NULL for an empty one)."""
    ids = labeled.sparkSession.range(k).select(F.col("id").cast("int").alias(cluster_col))
    return ids.join(F.broadcast(exact_medians(labeled, [cluster_col], cols, **kw)),
                    cluster_col, "left")


def global_medians(points: DataFrame, cols: Sequence[str], **kw) -> dict:
    """Exact median of every feature over all points (data-derived rule medians)."""
    medians = exact_medians(points, [], cols, **kw)
    row = medians.collect()[0]
    release(medians)
    return {c: row[c] for c in cols}


def category_scores(medians: DataFrame, rules: Rules = DEFAULT_RULES,
                    cluster_col: str = "cluster", f=square) -> DataFrame:
    """``cluster, category, score``."""
    scored = wide_scores(medians, rules, cluster_col, f)
    return (scored.unpivot([cluster_col], [f"score_{c}" for c in rules.categories],
                           "category", "score")
            .withColumn("category", F.regexp_replace("category", "^score_", "")))


def wide_scores(medians: DataFrame, rules: Rules = DEFAULT_RULES,
                cluster_col: str = "cluster", f=square) -> DataFrame:
    """``cluster`` and one ``score_<category>`` column each."""
    return medians.select(cluster_col, *[score_expr(rules, c, f=f).alias(f"score_{c}")
                                         for c in rules.categories])


def best_category_expr(rules: Rules = DEFAULT_RULES, prefix: str = "score_"):
    """Per row of the wide score table: the category with the highest
    (score, replication factor, -order), as ``greatest`` over structs."""
    keys = [f"named_struct('score', {qcol(prefix + c)}, 'rf', {int(rules.replication_factors[c])}, "
            f"'neg_order', {-i}, 'category', '{c.replace(chr(39), chr(39) * 2)}')"
            for i, c in enumerate(rules.categories)]
    best = keys[0] if len(keys) == 1 else "greatest(" + ", ".join(keys) + ")"
    return F.expr(f"{best}.category")


def classify(medians: DataFrame, rules: Rules = DEFAULT_RULES, cluster_col: str = "cluster",
             f=square) -> DataFrame:
    """``cluster, category`` from a median table with one row per cluster, as a
    projection (no shuffle)."""
    return wide_scores(medians, rules, cluster_col, f).select(
        cluster_col, best_category_expr(rules).alias("category"))
