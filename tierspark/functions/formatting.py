"""Text forms of cluster identifiers."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, functions as F


def centroid_id_text(values: Sequence[float], decimals: int = 4) -> str:
    """``CENTROID_`` + the centroid's values to 4 decimals, joined by ``_``. Formatted on
    the driver, which holds the k centroids anyway; rounding follows the exact binary
    value (``format_string`` rounds half up on the shortest decimal form)."""
    return "_".join(["CENTROID"] + [f"{float(v):.{decimals}f}" for v in values])


def cluster_name(cluster: Column) -> Column:
    """Integer cluster id -> ``C{i}``."""
    return F.concat(F.lit("C"), cluster.cast("string"))
