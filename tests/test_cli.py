"""Both jobs through their command lines: CSV in, feature CSV, centroid CSV."""

import glob
import os

from tests.conftest import SF_SMALL
from tierspark.plans import classification_job, feature_job
from tierspark.sources import files
from tierspark.sources.driver_tables import VIEWS


def test_feature_then_classification_job(spark, tmp_out):
    v = VIEWS["customer_events"]
    files.write_manifest(v.manifest_text(spark, SF_SMALL), f"{tmp_out}/manifest")
    files.write_access_log_text(v.log_text(spark, SF_SMALL), f"{tmp_out}/log")
    feature_job.main(["--manifest", f"{tmp_out}/manifest", "--access_log", f"{tmp_out}/log",
                      "--out", f"{tmp_out}/features", "--bucket_seconds", "3600"])
    feats = spark.read.option("header", True).csv(f"{tmp_out}/features")
    assert feats.count() == 150
    assert feats.columns[:6] == ["path", "access_freq", "age_seconds", "write_ratio",
                                 "locality", "concurrency"]
    import json
    from tierspark.schemas import DEFAULT_RULES
    rules = DEFAULT_RULES.to_dict()
    rules["global_medians"] = {f: 0.4 for f in rules["features"]}
    with open(f"{tmp_out}/rules.json", "w") as fh:
        json.dump(rules, fh)
    classification_job.main(["--input_path", f"{tmp_out}/features", "--k", "4",
                             "--output_csv", f"{tmp_out}/final", "--files_out", f"{tmp_out}/tiers",
                             "--rules", f"{tmp_out}/rules.json"])
    parts = glob.glob(f"{tmp_out}/final/part-*.csv")
    assert len(parts) == 1
    lines = open(parts[0]).read().splitlines()
    assert lines[0] == ("centroid_id,category,access_freq_norm,age_norm,write_ratio_norm,"
                        "locality_norm,concurrency_norm")
    assert len(lines) == 5
    assert spark.read.parquet(f"{tmp_out}/tiers").count() == 150
    assert os.path.isdir(f"{tmp_out}/tiers")
