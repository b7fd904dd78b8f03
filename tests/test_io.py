"""Sources and sinks (S1-S8): round trips and binding rules."""

import os

import pytest
from pyspark.sql import functions as F

from tierspark.sources import files
from tierspark.plans.feature_job import compute_features


def _write_text(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_manifest_binds_by_header_name(spark, tmp_out):
    p = f"{tmp_out}/m/part-0.csv"
    _write_text(p, "category,size_bytes,primary_node,creation_ts,path\n"
                   "hot,10,dn2,2025-06-12T09:40:32.335400Z,/a\n"
                   "cold,20,dn1,not-a-time,/b\n")
    m = files.read_manifest(spark, f"{tmp_out}/m")
    assert m.columns == ["path", "creation_ts", "primary_node", "size_bytes", "category"]
    rows = {r["path"]: r for r in files.parse_manifest(m).collect()}
    assert rows["/a"]["primary_node"] == "dn2"
    # whole seconds: the fraction is dropped
    assert rows["/a"]["creation_epoch"] == 1749721232.0
    assert rows["/b"]["creation_epoch"] is None


def test_files_with_other_header_orders_are_read_by_name(spark, tmp_out):
    _write_text(f"{tmp_out}/m/part-0.csv", "path,creation_ts,primary_node\n/a,t,dn1\n/c,t,dn3\n")
    _write_text(f"{tmp_out}/m/part-1.csv", "primary_node,path,creation_ts,category\ndn2,/b,t,hot\n")
    rows = {r["path"]: r for r in files.read_manifest(spark, f"{tmp_out}/m").collect()}
    assert {p: r["primary_node"] for p, r in rows.items()} == {"/a": "dn1", "/b": "dn2", "/c": "dn3"}
    assert rows["/b"]["category"] == "hot" and rows["/a"]["category"] is None


def test_headers_of_split_empty_and_many_files(spark, tmp_out):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        for i in range(40):
            cols = ["path", "creation_ts", "primary_node"]
            cols = cols[i % 3:] + cols[:i % 3]
            rows = "".join(",".join(f"{c[0]}{i}-{j}" for c in cols) + "\n" for j in range(9))
            _write_text(f"{tmp_out}/m/part-{i:02}.csv", ",".join(cols) + "\n" + rows)
        _write_text(f"{tmp_out}/m/part-99.csv", "")
        m = files.read_manifest(spark, f"{tmp_out}/m").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["path"], r["creation_ts"], r["primary_node"]) for r in m) == sorted(
        (f"p{i}-{j}", f"c{i}-{j}", f"p{i}-{j}") for i in range(40) for j in range(9))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_export_order_does_not_depend_on_the_splits(spark, tmp_out, fmt):
    cols = "ts_iso string, path string, op string, client_node string, pid string"
    for part in range(2):  # two files, in name order
        rows = [(f"2025-01-01T00:00:0{i % 3}.000Z", f"/p{9 - i % 7}", "READ", "dn1",
                 f"{part}-{i:04}") for i in range(2000)]
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").option(
            "parquet.block.size", 4096).format(fmt).save(f"{tmp_out}/{part}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    try:
        for size in ("128m", "2k", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = spark.read.schema(cols).format(fmt).load([f"{tmp_out}/0", f"{tmp_out}/1"])
            got.append([r["pid"] for r in files.export_log(read.where("op = 'READ'")).collect()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"{part}-{i:04}" for k in range(3) for part in range(2)
            for i in range(2000) if i % 3 == k]
    assert got == [want] * 3


def test_feature_table_with_missing_columns_is_refused(spark, tmp_out):
    _write_text(f"{tmp_out}/f/part-0.csv", "path,access_freq\n/a,1\n")
    with pytest.raises(ValueError, match="lacks"):
        files.read_features(spark, f"{tmp_out}/f", "csv")


def test_export_keeps_the_input_order_of_equal_times(spark, tmp_out):
    t = "2025-01-01T00:00:0{}.000Z"
    rows = [(t.format(i % 2), f"/p{9 - i}", "READ", "dn1", str(i)) for i in range(10)]
    log = spark.createDataFrame(rows, "ts_iso string, path string, op string, client_node string, pid string")
    got = [r["pid"] for r in files.export_log(log).collect()]
    assert got == ["0", "2", "4", "6", "8", "1", "3", "5", "7", "9"]


def test_a_closed_run_leaves_nothing_behind(spark, tmp_out):
    from tests.conftest import SF_SMALL
    from tierspark.plans.pipeline import run_tiering
    from tierspark.session import checkpoint_root
    from tierspark.sources.driver_tables import VIEWS
    root = checkpoint_root(spark).replace("file:", "") + "/tierspark"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    v = VIEWS["customer_events"]
    run = run_tiering(v.manifest(spark, SF_SMALL), v.log(spark, SF_SMALL), v.width)
    assert len(run.table.collect()) == 4 and run.files.count() == 150
    assert set(os.listdir(root)) - before
    run.close()
    assert set(os.listdir(root)) <= before


def test_access_log_binds_by_position(spark, tmp_out):
    _write_text(f"{tmp_out}/log/a.csv",
                "2025-12-15T06:37:19.767Z,/a,READ,dn1,1234\n"
                "2025-12-15T06:37:20.001Z,/a,WRITE,dn2,99\n"
                "garbage,/b,READ\n")
    log = files.parse_access_log(files.read_access_log(spark, f"{tmp_out}/log/*.csv"))
    rows = log.orderBy("ts_iso").collect()
    assert [r["path"] for r in rows] == ["/a", "/a", "/b"]
    assert rows[0]["ts_epoch"] == pytest.approx(1765780639.767, abs=1e-6)
    assert rows[2]["ts_epoch"] is None and rows[2]["client_node"] is None


def test_missing_input_raises(spark, tmp_out):
    with pytest.raises(FileNotFoundError):
        files.read_manifest(spark, f"{tmp_out}/nothing-here")


def test_features_round_trip_csv_and_parquet(spark, tmp_out):
    m = spark.createDataFrame([("a", 0.0, "dn1"), ("b", 5.0, "dn2")],
                              "path string, creation_epoch double, primary_node string")
    log = spark.createDataFrame([("a", 10.0, "WRITE", "dn1"), ("b", 11.0, "READ", "dn1")],
                                "path string, ts_epoch double, op string, client_node string")
    feats = compute_features(m, log).features
    want = sorted(map(tuple, feats.collect()))
    for fmt in ("csv", "parquet"):
        out = f"{tmp_out}/feat-{fmt}"
        files.write_features(feats, out, fmt=fmt, single_file=(fmt == "csv"))
        back = files.read_features(spark, out, fmt)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in feats.schema]
        assert sorted(map(tuple, back.collect())) == want
    # a CSV folder with several part files is read whole
    files.write_features(feats.repartition(2), f"{tmp_out}/feat-multi", fmt="csv")
    assert files.read_features(spark, f"{tmp_out}/feat-multi", "csv").count() == 2


def test_manifest_and_log_sinks_round_trip(spark, tmp_out):
    m = spark.createDataFrame([("/a", "2025-01-01T00:00:00.000001Z", "dn1", "7", "hot")],
                              "path string, creation_ts string, primary_node string, "
                              "size_bytes string, category string")
    files.write_manifest(m, f"{tmp_out}/man")
    assert files.read_manifest(spark, f"{tmp_out}/man").collect() == m.collect()
    log = spark.createDataFrame(
        [("2025-01-01T00:00:02.000Z", "/a", "READ", "dn1", "1"),
         ("2025-01-01T00:00:01.000Z", "/a", "WRITE", "dn2", "2")],
        "ts_iso string, path string, op string, client_node string, pid string")
    ordered = files.export_log(log, f"{tmp_out}/log")
    assert [r["ts_iso"] for r in ordered.collect()] == sorted(r["ts_iso"] for r in log.collect())
    back = files.read_access_log(spark, f"{tmp_out}/log")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, log.collect()))
    text = "".join(open(os.path.join(f"{tmp_out}/log", f)).read()
                   for f in sorted(os.listdir(f"{tmp_out}/log")) if f.endswith(".csv"))
    assert text.splitlines()[0].split(",") == ["2025-01-01T00:00:01.000Z", "/a", "WRITE", "dn2", "2"]


def test_result_table_sink(spark, tmp_out):
    t = spark.createDataFrame([("CENTROID_0.1000", "Hot", 0.1)], "centroid_id string, category string, x double")
    files.write_table(t, f"{tmp_out}/res", fmt="csv", single_file=True)
    back = spark.read.option("header", True).csv(f"{tmp_out}/res")
    assert back.columns == ["centroid_id", "category", "x"]
    assert back.collect()[0]["category"] == "Hot"


def test_iso_millis_truncates(spark):
    from tierspark.functions.timefmt import iso_millis
    ts = F.lit("2025-12-15 06:37:19.767900").cast("timestamp_ntz")
    df = spark.range(1).select(iso_millis(ts).alias("s"))
    assert df.collect()[0]["s"] == "2025-12-15T06:37:19.767Z"


def test_export_splits_a_hot_second(spark, tmp_out):
    hot = "2025-01-01T00:00:00.000Z"
    rows = [(hot, f"/p{i % 50}", "READ", f"dn{i % 3}", str(i)) for i in range(3000)]
    rows += [(f"2025-01-01T00:00:{s:02d}.000Z", "/q", "WRITE", "dn1", "1") for s in range(1, 60)]
    log = spark.createDataFrame(rows, "ts_iso string, path string, op string, client_node string, pid string")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")      # tiny data: keep the range partitions apart
    try:
        files.export_log(log.repartition(6), f"{tmp_out}/hot")
    finally:
        spark.conf.set(key, old)
    parts = sorted(f for f in os.listdir(f"{tmp_out}/hot") if f.endswith(".csv"))
    sizes = [sum(1 for _ in open(f"{tmp_out}/hot/{f}")) for f in parts]
    assert sum(sizes) == len(rows)
    assert max(sizes) < 3000          # the hot second is spread over several files
    text = [line.split(",")[0] for f in parts for line in open(f"{tmp_out}/hot/{f}")]
    assert text == sorted(text)


def test_shuffle_partitions_sized_from_input(spark):
    from tierspark.session import estimated_bytes, size_shuffle_partitions
    from tests.conftest import SF_SMALL
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    assert estimated_bytes(df) > 0
    n = size_shuffle_partitions(spark, df)
    assert n == int(spark.conf.get("spark.sql.shuffle.partitions")) >= 4


def test_materialize_writes_under_the_session_checkpoint_dir(spark):
    from tierspark.session import checkpoint_root, materialize
    root = checkpoint_root(spark)
    conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        assert root == conf_dir.rstrip("/")
    df = materialize(spark.range(10).withColumnRenamed("id", "x"), "unit")
    files_read = df.inputFiles()
    assert files_read and all(root.replace("file:", "") in f.replace("file:", "") for f in files_read)
    assert df.count() == 10


def test_scratch_scope_deletes_what_was_written_in_it(spark, tmp_out):
    from tierspark.session import checkpoint_root, materialize, scratch_scope
    root = checkpoint_root(spark).replace("file:", "") + "/tierspark"
    kept = materialize(spark.range(3).toDF("x"), "kept")
    before = set(os.listdir(root))
    with scratch_scope(spark):
        materialize(spark.range(5).toDF("x"), "scoped").write.parquet(f"{tmp_out}/out")
        assert set(os.listdir(root)) - before
    assert set(os.listdir(root)) == before
    assert spark.read.parquet(f"{tmp_out}/out").count() == 5 and kept.count() == 3


def test_registry_queries_leave_no_cached_tables(spark):
    import __spark_entry__ as entry
    from tests.conftest import SF_SMALL
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    entry.queries()["kmeans_update"](spark, SF_SMALL).collect()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
