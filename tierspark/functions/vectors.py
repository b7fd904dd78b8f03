"""Distances to a small set of centres held as literals.

Centres are at most k x d numbers known on the driver; they enter the plan as one
array literal, and a higher-order function gives each row its k distances, so no
points x centres join is formed, the generated code neither grows with k x d nor
is compiled anew when the centres move. Expressions are one SQL string each;
doubles are written as ``repr(x)D``, which parses back to exactly the same double.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, functions as F


def dlit(x: float) -> str:
    x = float(x)
    if not math.isfinite(x):
        raise ValueError(f"centre coordinate must be finite, got {x}")
    return f"{x!r}D"


def qcol(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def complete_sql(cols: Sequence[str]) -> str:
    """No coordinate is NULL or NaN (one sum tells: either would make it so)."""
    return f"NOT isnan(coalesce({' + '.join(f'abs({qcol(c)})' for c in cols)}, double('nan')))"


def distances_sql(cols: Sequence[str], centers: Sequence[Sequence[float]]) -> str:
    """Array of squared distances to every centre, in centre order, each summed in
    the fixed feature order."""
    rows = ", ".join("array(" + ", ".join(dlit(v) for v in c) + ")" for c in centers)
    terms = " + ".join(f"({qcol(c)} - c[{i}]) * ({qcol(c)} - c[{i}])" for i, c in enumerate(cols))
    return f"transform(array({rows}), c -> {terms})"


def nearest_index(cols: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """Nearest centre, lowest index on ties; NULL for a point with a missing coordinate."""
    first = (f"transform(array({distances_sql(cols, centers)}), "
             "d -> CAST(array_position(d, array_min(d)) - 1 AS INT))[0]")
    return F.expr(f"CASE WHEN {complete_sql(cols)} THEN {first} END")


def min_sq_dist(cols: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """Squared distance to the nearest centre (D^2 of k-means++); NULL for a point with a
    missing coordinate."""
    return F.expr(f"CASE WHEN {complete_sql(cols)} "
                  f"THEN array_min({distances_sql(cols, centers)}) END")
