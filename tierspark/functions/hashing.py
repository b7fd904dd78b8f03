"""Deterministic per-row uniforms for seeded sampling.

u = (first 13 hex digits of md5("seed:stream:id") + 1) / (2^52 + 1), in (0, 1).
It depends only on the seed, the stream number and the row key, so a draw is
the same whatever the partitioning or the number of executors. The same value
is computable in plain SQL (``md5`` + hex parse), which the oracle uses.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DEN = float(2**52 + 1)


def uniform01_sql(seed: int, stream: int | str, id_sql: str) -> str:
    prefix = f"{int(seed)}:{stream}:".replace("'", "''")
    digits = f"CAST(conv(substring(md5(concat('{prefix}', CAST({id_sql} AS STRING))), 1, 13), 16, 10) AS BIGINT)"
    return f"((CAST({digits} AS DOUBLE) + 1.0D) / {_DEN!r}D)"


def uniform01(seed: int, stream: int | str, id_col: Column | str) -> Column:
    """``id_col``: a column name (one SQL expression, cheap to build) or a Column."""
    if isinstance(id_col, str):
        return F.expr(uniform01_sql(seed, stream, "`" + id_col.replace("`", "``") + "`"))
    key = F.concat(F.lit(f"{int(seed)}:{stream}:"), id_col.cast("string"))
    digits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")
    return (digits.cast("double") + F.lit(1.0)) / F.lit(_DEN)
