"""The driver's Parquet tables seen as a file manifest and an access log.

Two mappings are used throughout tests, oracle and bench:

* view ``customer_events`` (correctness): manifest = ``customer``, log = ``events``;
  bucket width 3,600 s (at one second every accessed file peaks at 1 here).
* view ``part_lineitem`` (bench): manifest = ``part``, log = ``lineitem``;
  bucket width 86,400 s.

Two more views hold edge cases of the same tables:

* ``supplier_events``: manifest = ``supplier``, all created at one time, log = ``events``
  (most log rows belong to no supplier; the age is a constant feature);
* ``edges``: ``customer`` and ``events`` with missing creation times, primary nodes,
  access times and clients.

All read their whole tables; the mapped columns are plain projections.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierspark.functions.timefmt import epoch_seconds, iso_micros, iso_millis

def _ntz_epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _node(col) -> F.Column:
    return F.concat(F.lit("dn"), (col % F.lit(3) + F.lit(1)).cast("string"))


@dataclass(frozen=True)
class View:
    name: str
    width: float
    manifest: Callable[[SparkSession, str], DataFrame]
    log: Callable[[SparkSession, str], DataFrame]
    manifest_text: Callable[[SparkSession, str], DataFrame] | None = None
    log_text: Callable[[SparkSession, str], DataFrame] | None = None


# ----- customer / events ----------------------------------------------------------

def _ce_manifest(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("path"),
        (F.lit(1672531200) + F.col("c_custkey") * F.lit(1800)).cast("double").alias("creation_epoch"),
        _node(F.col("c_nationkey")).alias("primary_node"),
    )


def _ce_op():
    return (F.when(F.col("event_type").isin("purchase", "signup"), F.lit("WRITE"))
            .when(F.col("event_type").isin("view", "click"), F.lit("READ"))
            .when(F.col("event_type") == "error", F.lit("DELETE")))


def _ce_log(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("path"),
        epoch_seconds(F.col("ts"), e.schema["ts"].dataType).alias("ts_epoch"),
        _ce_op().alias("op"),
        _node(F.col("event_id")).alias("client_node"),
    )


def _ce_manifest_text(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    # creation time with a sub-second part, which parsing drops again
    micros = ((F.lit(1672531200) + F.col("c_custkey") * F.lit(1800)) * F.lit(1_000_000)
              + (F.col("c_custkey") % F.lit(1000)) * F.lit(1000))
    return c.select(
        F.col("c_custkey").cast("string").alias("path"),
        iso_micros(F.timestamp_add("MICROSECOND", micros, _ntz_epoch())).alias("creation_ts"),
        _node(F.col("c_nationkey")).alias("primary_node"),
        (F.lit(1024) * (F.col("c_custkey") + F.lit(1))).cast("string").alias("size_bytes"),
        F.lower(F.col("c_mktsegment")).alias("category"),
    )


def _ce_log_text(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    return e.select(
        iso_millis(F.col("ts").cast("timestamp_ntz")).alias("ts_iso"),
        F.col("user_id").cast("string").alias("path"),
        _ce_op().alias("op"),
        _node(F.col("event_id")).alias("client_node"),
        (F.lit(1000) + F.col("event_id") % F.lit(9000)).cast("string").alias("pid"),
    )


# ----- part / lineitem ------------------------------------------------------------

def _pl_manifest(spark, sf_dir):
    p = load_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("path"),
        (F.lit(757382400) + F.col("p_partkey") * F.lit(1000)).cast("double").alias("creation_epoch"),
        _node(F.col("p_partkey")).alias("primary_node"),
    )


def _pl_op():
    return (F.when(F.col("l_returnflag") == "A", F.lit("WRITE"))
            .when(F.col("l_returnflag") == "N", F.lit("READ"))
            .when(F.col("l_returnflag") == "R", F.lit("DELETE")))


def _pl_log(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").cast("string").alias("path"),
        epoch_seconds(F.col("l_shipdate"), li.schema["l_shipdate"].dataType).alias("ts_epoch"),
        _pl_op().alias("op"),
        _node(F.col("l_suppkey")).alias("client_node"),
    )


# ----- edge cases -------------------------------------------------------------------

def _se_manifest(spark, sf_dir):
    s = load_table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("path"),
                    F.lit(1672531200.0).alias("creation_epoch"),
                    _node(F.col("s_nationkey")).alias("primary_node"))


def _edge_manifest(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    epoch = (F.lit(1672531200) + F.col("c_custkey") * F.lit(1800)).cast("double")
    return c.select(F.col("c_custkey").cast("string").alias("path"),
                    F.when(segment != "BUILDING", epoch).alias("creation_epoch"),
                    F.when(segment != "MACHINERY", _node(F.col("c_nationkey"))).alias("primary_node"))


def _edge_log(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    kind = F.col("event_type")
    epoch = epoch_seconds(F.col("ts"), e.schema["ts"].dataType)
    return e.select(F.col("user_id").cast("string").alias("path"),
                    F.when(kind != "error", epoch).alias("ts_epoch"), _ce_op().alias("op"),
                    F.when(kind != "signup", _node(F.col("event_id"))).alias("client_node"))


VIEWS = {
    "customer_events": View("customer_events", 3600.0, _ce_manifest, _ce_log,
                            _ce_manifest_text, _ce_log_text),
    "part_lineitem": View("part_lineitem", 86400.0, _pl_manifest, _pl_log),
    "supplier_events": View("supplier_events", 3600.0, _se_manifest, _ce_log),
    "edges": View("edges", 3600.0, _edge_manifest, _edge_log),
}


# ----- embeddings: a second point set for the clustering operators --------------------

def embedding_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """(``vec`` (id as text) and one double column per coordinate, the columns). The
    width is that of the data; vectors of different widths raise."""
    e = load_table(spark, sf_dir, "embeddings")
    lo, hi = e.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if lo != hi:
        raise ValueError(f"embeddings have {lo} to {hi} coordinates")
    cols = [f"e{i:02d}" for i in range(hi or 0)]
    return e.select(F.col("vec_id").cast("string").alias("vec"),
                    *[F.col("embedding").getItem(i).cast("double").alias(c)
                      for i, c in enumerate(cols)]), cols
