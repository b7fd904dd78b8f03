"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tierspark",
                  shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with AQE on, UI off and UTC as session time zone.

    Without ``master`` the launcher decides (spark-submit's ``--master``).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session without the setting gets a
    private folder (tests); a cluster session without it is an error, because a
    machine-local folder is not visible to the other executors.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            d = None
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="tierspark-ckpt-")
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder name under the checkpoint root."""
    return f"{checkpoint_root(spark)}/tierspark/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, persist: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This cuts the lineage (a lost executor recomputes from the written files, not
    from the whole upstream plan) and gives later passes a column-pruned,
    vectorised scan. ``persist`` additionally keeps the re-read table in
    executor memory/disk for iterative use.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for own in _SCOPES:
        own.append(path)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    if persist:
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    return out


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, every table that :func:`materialize` wrote in it.
    What the block computes must be written elsewhere before it ends."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def complete_folders(spark: SparkSession, parent: str) -> list:
    """Folders directly under ``parent`` whose writer has marked them complete, by name;
    none if there is no such parent."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(parent)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(f.toString() for f in found
                  if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def release(df: DataFrame | None) -> None:
    """Delete the table behind a frame from :func:`materialize`. Only folders that
    :func:`scratch_path` named are touched."""
    if df is None:
        return
    df.unpersist()
    spark = df.sparkSession
    root = f"{checkpoint_root(spark)}/tierspark/".split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root):
            _delete(spark, folder)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def size_shuffle_partitions(spark: SparkSession, *inputs: DataFrame,
                            target_bytes: int = 128 * 1024 * 1024, lo: int = 8) -> int:
    """Set ``spark.sql.shuffle.partitions`` to about input bytes / ``target_bytes``
    (AQE coalesces downward from it), unless the launcher set it explicitly.
    Returns the value in effect."""
    key = "spark.sql.shuffle.partitions"
    if spark.sparkContext.getConf().contains(key):
        return int(spark.conf.get(key))
    total = sum(estimated_bytes(d) for d in inputs)
    n = max(lo, -(-total // target_bytes))
    spark.conf.set(key, str(n))
    return n
