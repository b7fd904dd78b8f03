"""File sources and sinks (CSV with the reference's layouts, Parquet by default
for intermediate tables).

* manifest: CSV with header, every column text, columns bound by **name**;
* access log: CSV without header, five text columns bound by **position**;
* feature table / result table: CSV with header or Parquet.

Readers accept a file, a directory of part files or a glob and read all parts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tierspark.functions.timefmt import parse_iso_epoch, parse_iso_whole_seconds
from tierspark.schemas import ACCESS_LOG_TEXT, FEATURE_TABLE, MANIFEST_TEXT


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hpath)
    return found is not None and len(found) > 0


def resolve_input(spark: SparkSession, path: str) -> str:
    """Check that ``path`` (file, directory or glob) matches something.

    Spark reads every part file of a directory or glob, so there is no need to
    pick the first ``part-00000`` file; a missing input raises instead of
    printing and returning.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"no input matches {path}")
    return path


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, head): the first line of every file. Spark has no source that stops after a
    file's first line, and a Python task that stops early still has its whole split read
    for it, so this is a scan of the lines, one row per task and file behind it."""
    lines = spark.read.text(resolve_input(spark, path)).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("head"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"))
    return lines.where("at = 0").groupBy("file").agg(F.min_by("head", "row").alias("head"))


def _csv_by_name(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of ``path``, each bound by its own header line; columns that a file
    lacks are NULL. Files with the same header are read together; if all have the same, no
    file name comes to the driver."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    heads = _first_lines(spark, path)
    kinds = [r["head"] for r in heads.select("head").distinct().collect()]
    if len(kinds) <= 1:
        return reader.csv(path)
    files = (heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files"))
             .collect())
    out, *others = [reader.csv(r["files"]) for r in sorted(files, key=lambda r: r["files"])]
    for part in others:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest CSV with header; columns bound by header name, all strings."""
    raw = _csv_by_name(spark, path)
    missing = [c for c in ("path", "creation_ts", "primary_node") if c not in raw.columns]
    if missing:
        raise ValueError(f"manifest lacks columns {missing}")
    cols = [F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string").alias(f.name)
            for f in MANIFEST_TEXT.fields]
    return raw.select(*cols)


def parse_manifest(text: DataFrame) -> DataFrame:
    """Text manifest -> ``path, creation_epoch`` (whole seconds, NULL when the
    text does not parse), ``primary_node`` plus the untouched text columns."""
    return text.withColumn("creation_epoch", parse_iso_whole_seconds(F.col("creation_ts")))


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Headerless access-log CSV with the fixed five-string schema (positional)."""
    return (spark.read.schema(ACCESS_LOG_TEXT).option("header", False)
            .option("mode", "PERMISSIVE").csv(resolve_input(spark, path)))


def parse_access_log(text: DataFrame) -> DataFrame:
    """Text log -> adds ``ts_epoch`` (seconds with fraction, NULL if unparsable)."""
    return text.withColumn("ts_epoch", parse_iso_epoch(F.col("ts_iso")))


def write_features(df: DataFrame, path: str, fmt: str = "parquet",
                   single_file: bool = False, mode: str = "overwrite") -> None:
    """Feature sink. CSV gets a header. ``single_file`` coalesces to one part,
    which funnels the last stage into one task: only for small outputs."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Feature table back with its declared types (CSV columns by header name)."""
    path = resolve_input(spark, path)
    if fmt == "csv":
        raw = _csv_by_name(spark, path)
    else:
        raw = spark.read.format(fmt).load(path)
    missing = [c for c in FEATURE_TABLE.fieldNames() if c not in raw.columns]
    if missing:
        raise ValueError(f"feature table lacks columns {missing}")
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURE_TABLE.fields]
    extra = [c for c in raw.columns if c not in FEATURE_TABLE.fieldNames()]
    return raw.select(*cols, *extra)


def write_table(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False,
                mode: str = "overwrite") -> None:
    """Result sink (centroid/category table, per-file tiers)."""
    write_features(df, path, fmt=fmt, single_file=single_file, mode=mode)


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Manifest sink: CSV with header, the five manifest columns as text."""
    cols = [F.col(f.name).cast("string") if f.name in df.columns
            else F.lit(None).cast("string").alias(f.name) for f in MANIFEST_TEXT.fields]
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def write_access_log_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Log sink: headerless CSV, columns ts_iso, path, op, client_node, pid."""
    cols = [F.col(f.name).cast("string") if f.name in df.columns
            else F.lit(None).cast("string").alias(f.name) for f in ACCESS_LOG_TEXT.fields]
    df.select(*cols).write.mode(mode).option("header", False).csv(path)


def _row_place(df: DataFrame) -> list[Column]:
    """Where a row stands in the input, for rows that tie: its file and row (Parquet), or
    its file, split and order in the split (text). Neither depends on how Spark cuts the
    files into tasks, nor on which attempt of a task reads them. Rows that do not come
    from files are numbered as they arrive."""
    row = F.monotonically_increasing_id()
    for place in (["file_path", "row_index"], ["file_path", "file_block_start"]):
        cols = [F.col(f"_metadata.{c}") for c in place]
        try:
            df.select(*cols).schema
        except AnalysisException:
            continue
        return cols if "row_index" in place else [*cols, row]
    return [row]


def export_log(df: DataFrame, path: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Access log in time order (text order of the fixed-width ISO form equals
    time order); rows of the same timestamp keep their input order (files by name).
    ``orderBy`` range-partitions, so the sort is distributed and the part files are
    globally ordered; the place in the input makes the key unique, so the range bounds can
    split even a second that holds a large share of the log. Returns the ordered DataFrame
    and, with ``path``, writes it as headerless CSV."""
    cols = [F.col(f.name).cast("string") if f.name in df.columns
            else F.lit(None).cast("string").alias(f.name) for f in ACCESS_LOG_TEXT.fields]
    places = {f"_place{i}": c for i, c in enumerate(_row_place(df))}
    ordered = (df.select(*cols, *[c.alias(n) for n, c in places.items()])
               .orderBy("ts_iso", *places).drop(*places))
    if path is not None:
        ordered.write.mode(mode).option("header", False).csv(path)
    return ordered
