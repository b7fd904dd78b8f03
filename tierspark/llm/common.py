"""Shared column expressions and scratch tables of the operators in this folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierspark.session import materialize, release

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
MAX_ID = 2**63 - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def order_id(doc_id: str = "doc_id") -> Column:
    """The id as an ordering key that is never null: a null id counts as the largest."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(MAX_ID))


def id_of(order: str | Column) -> Column:
    """Inverse of :func:`order_id`."""
    c = F.col(order) if isinstance(order, str) else order
    return F.when(c != MAX_ID, c)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z only. Pure ASCII strings take the JVM's fast lower-casing; the rest
    go letter by letter, because ``lower`` would change letters beyond ASCII."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, LOWER)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_setting(spark: SparkSession, key: str) -> int:
    """A size setting of the session ("8m", "64MB", "67108864b") in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", spark.conf.get(key).lower()).groups()
    return int(number) * 1024 ** " kmgt".index(unit or " ")


def crc_fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


__all__ = ["MAX_ID", "ascii_lower", "bytes_setting", "crc_fold", "documents", "id_of", "materialize",
           "order_id", "partitions", "release", "whole_text"]
