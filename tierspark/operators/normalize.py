"""Min-max normalisation with the reference's degenerate-range rule.

``(x - min) / (max - min)``, and 0.0 for every row when ``max == min`` or when
either bound is NULL (empty table). Not ``ml.feature.MinMaxScaler``, which maps
a constant column to the mid-point.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def feature_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``min_<c>`` and ``max_<c>`` for every column, in one pass
    (partial aggregation per task, a single-row final)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs)


def collect_ranges(df: DataFrame, cols: Sequence[str]) -> dict:
    row = feature_ranges(df, cols).collect()[0]
    return {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in cols}


def minmax_col(c: str, lo, hi) -> Column:
    if lo is None or hi is None or lo == hi:
        return F.lit(0.0)
    return ((F.col(c).cast("double") - F.lit(float(lo)))
            / (F.lit(float(hi)) - F.lit(float(lo))))


def minmax_normalize(df: DataFrame, names: Mapping[str, str],
                     ranges: Mapping[str, tuple] | None = None) -> DataFrame:
    """Adds ``names[c]`` = normalised ``c`` for every key of ``names``.

    ``ranges`` (``{c: (min, max)}``) can come from an earlier pass; otherwise one
    aggregate computes them.
    """
    if ranges is None:
        ranges = collect_ranges(df, list(names))
    return df.withColumns({n: minmax_col(c, *ranges[c]) for c, n in names.items()})
