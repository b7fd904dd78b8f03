"""Quality and language on held-out rows and on the messy table; the pipeline."""

import os
import zlib

import numpy as np
import pytest

from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm import messy
from tierspark.llm import langid_kn, quality_qda
from tierspark.llm.common import documents


def fold(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def test_quality_on_held_out_rows(spark):
    rows = quality_qda.op2_quality(spark, SF_ORACLE).collect()
    label = {r["doc_id"]: r["quality"] for r in
             spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    assert len(rows) == documents(spark, SF_ORACLE).count()
    for r in rows:
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    out = [(r["score"], label[r["doc_id"]], r["predicted"]) for r in rows
           if r["held_out"] and r["doc_id"] in label]
    good, bad = [s for s, y, _ in out if y], [s for s, y, _ in out if not y]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([y == p for _, y, p in out]) > 0.95


def test_quality_never_sees_held_out_labels(spark):
    docs = documents(spark, SF_SMALL)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    from tierspark.llm.common import crc_fold
    flipped = labels.selectExpr("doc_id", "quality", "toxic").withColumn(
        "quality", (labels["quality"] * 0 + 1).cast("int") - labels["quality"]).where(
        crc_fold("doc_id", 5) == 0)
    mixed = labels.where(crc_fold("doc_id", 5) != 0).unionByName(flipped.select(*labels.columns))
    a = sorted((r["doc_id"], round(r["score"], 9)) for r in quality_qda.scores(docs, labels).collect())
    b = sorted((r["doc_id"], round(r["score"], 9)) for r in quality_qda.scores(docs, mixed).collect())
    assert a == b


def test_quality_of_messy_documents(spark):
    d = messy.docs(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(24)] + [(1, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality_qda.scores(d, labels).collect()
    assert len(rows) == len(messy.rows()) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (0, 1)}
    assert len(empty) == 1                                  # null and empty are the same text
    kept = quality_qda.keep_good(d, labels)
    assert kept.columns == d.columns
    good = sum(r["predicted"] for r in rows)
    assert kept.count() == good
    none = quality_qda.scores(d, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_qda.scores(messy.no_docs(spark), labels).collect() == []


def test_shrunken_discriminant_against_densities():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (400, 3)) @ np.diag([1, 2, 3]), 1: rng.normal(1, 1, (300, 3))}
    sums = {c: (lambda z: z.T @ z)(np.hstack([np.ones((len(v), 1)), v])) for c, v in x.items()}
    m = quality_qda.Discriminant(sums, to_pooled=0.0, to_identity=0.0)
    p = rng.normal(0, 2, (50, 3))
    want = np.zeros(50)
    for c, sign in ((1, 1), (0, -1)):
        cov = np.cov(x[c].T, bias=True)
        diff = p - x[c].mean(axis=0)
        want += sign * -0.5 * ((diff @ np.linalg.inv(cov) * diff).sum(axis=1)
                               + np.linalg.slogdet(cov)[1])
    assert np.allclose(np.sinh(m.difference(p)), want)


def test_language_on_held_out_rows(spark):
    rows = langid_kn.op7_language(spark, SF_ORACLE).collect()
    lang = {r["doc_id"]: r["lang"] for r in documents(spark, SF_ORACLE).collect()}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(out) > 0.98


def test_language_of_messy_documents(spark):
    model = langid_kn.train(messy.docs(spark))
    rows = langid_kn.predict(messy.docs(spark), model).collect()
    assert len(rows) == len(messy.rows())
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {0, 1, 2, 3, None}
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in rows} <= {"und", "en", "de", "fr"}
    nothing = langid_kn.train(messy.no_docs(spark))
    assert nothing is None
    assert {r["lang_pred"] for r in langid_kn.predict(messy.docs(spark), nothing).collect()} == {"und"}


def test_kneser_ney_probabilities_sum_to_one():
    texts = {"a": "abab cab bac abc cabbage", "b": "xyz zyx xyzzy"}
    langs, seqs = [], []
    for i, t in enumerate(texts.values()):
        s = langid_kn.sequences(langid_kn.letters(t))
        seqs.append(s)
        langs += [i] * len(s)
    m = langid_kn.KneserNey(list(texts), np.array(langs), np.concatenate(seqs), np.ones(len(langs)))
    seen = m.prob[1].values.shape[0]
    alphabet = sorted({int(x & 0xFFFF) for x in np.concatenate(seqs)})
    assert seen == len(alphabet)
    for ctx in ("cab", "zzy", "qqq"):
        c = [ord(x) for x in ctx]
        keys = np.array([c[0] << 48 | c[1] << 32 | c[2] << 16 | w for w in alphabet], np.uint64)
        total = np.exp(m.log_probs(keys)).sum(axis=0)
        # one more share of the lowest order is for letters never seen
        assert np.all(total <= 1 + 1e-5) and np.all(total > 0.8)


def test_hash_array_finds_exactly_its_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    a = langid_kn.HashArray(keys[::2], 3, np.arange(len(keys[::2])))
    at = a.find(keys)
    assert (a.values[at[::2]] == np.arange(len(keys[::2]))).all() and (at[1::2] == -1).all()


# ---- the pipeline -------------------------------------------------------------------


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline
    return corpus_pipeline


def test_stages(spark, pipeline, tmp_out):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_leaks",
                                               "mixing", "sharding"]
    docs = documents(spark, SF_SMALL)
    columns, seen = docs.columns, []
    for n, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_out}/{n}")
        docs = spark.read.parquet(f"{tmp_out}/{n}")
        seen.append(docs.count())
        if n < 4:
            assert docs.columns == columns
    assert seen[0] > seen[1] > seen[2] == seen[3] == seen[4] > 0
    assert set(docs.columns) == {*columns, "size", "shard"}
    again = pipeline.run(spark, SF_SMALL)
    assert sorted(r["doc_id"] for r in again.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_pipeline_of_messy_documents(spark, pipeline, tmp_out):
    messy.docs(spark).write.parquet(f"{tmp_out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(24)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_out}/labels.parquet")
    spark.createDataFrame([(1, messy.rows()[25][1])], "item_id long, text string").write.parquet(
        f"{tmp_out}/benchmark.parquet")
    out = pipeline.run(spark, tmp_out)
    rows = out.collect()
    assert rows and not any(messy.rows()[25][1] in (r["text"] or "") for r in rows)
    assert not {8, 9, 23} & {r["doc_id"] for r in rows}
    assert os.path.isdir(f"{tmp_out}/documents.parquet")


def test_pipeline_of_nothing(spark, pipeline, tmp_out):
    messy.no_docs(spark).write.parquet(f"{tmp_out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_out}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_out}/benchmark.parquet")
    assert pipeline.run(spark, tmp_out).collect() == []
