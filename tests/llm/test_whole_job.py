"""Nothing is left out of the language model, the mix and the shards."""

import collections
import random

import numpy as np

from tierspark.llm import langid_kn, pfair_mix


# ---- language -----------------------------------------------------------------------


def some_counts():
    random.seed(11)
    texts = {"a": "abab cab bac abc cabbage " * 3, "b": "xyz zyx xyzzy cab",
             "c": "".join(random.choice("abcdefgh ijk一丁龥") for _ in range(3000))}
    out = []
    for lang, t in texts.items():
        seqs, n = np.unique(langid_kn.sequences(langid_kn.letters(t)), return_counts=True)
        out += [(lang, int(s), int(c)) for s, c in zip(seqs.view(np.int64), n)]
    return list(texts), out


def test_weights_add_up_to_the_model_in_memory(spark):
    langs, rows = some_counts()
    want = langid_kn.KneserNey(langs, np.array([langs.index(r[0]) for r in rows]),
                               np.array([r[1] for r in rows]).view(np.uint64),
                               np.array([float(r[2]) for r in rows]))
    known = np.array([r[1] for r in rows]).view(np.uint64)
    strange = [int(x) for x in known[::7]]
    keys = np.unique(np.concatenate([known, np.array(
        [x ^ 5 for x in strange] + [x ^ 3 << 16 for x in strange] + [x ^ 7 << 48 for x in strange]
        + [0x0041004200430044], np.uint64)]))
    table = spark.createDataFrame(rows, "lang string, seq long, n long")
    for block_rows in (10**6, 1000):
        m = langid_kn.fit(table, block_rows)
        assert m.langs == want.langs and (len(m.blocks) > 1) == (block_rows == 1000)
        got = np.array(spark.sparkContext.parallelize([0], 1).map(
            lambda _: m.log_probs(keys)).first())
        assert np.allclose(got, want.log_probs(keys), atol=1e-4)


def test_rare_sequences_of_a_small_language_are_kept(spark):
    random.seed(12)  # 450,000 sequences occur twice, and once each those of a small language
    big = [(i, "".join(chr(0x4e00 + random.randrange(20000)) for _ in range(5000)), "big")
           for i in range(100)]
    docs = spark.createDataFrame(
        [r for i, t, l in big for r in ((3 * i + 1000, t, l), (3 * i + 1001, t, l))]
        + [(i, "pilvi kulkee taivaalla", "small") for i in range(3)], "doc_id long, text string, lang string")
    m = langid_kn.train(docs)
    assert m.langs == ["big", "small"]
    rows = spark.createDataFrame([(1, "taivaalla kulkee pilvi")], "doc_id long, text string")
    assert langid_kn.predict(rows, m).first()["lang_pred"] == "small"


def test_languages_that_only_the_calibrating_tenth_holds_are_learned(spark):
    import zlib
    tenth = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 30 // 3 == 0]
    most = [i for i in range(2000) if i not in set(tenth)]
    rows = ([(i, f"the weather is fine today number {i}", "en") for i in most[:60] + tenth[:20]]
            + [(i, f"pilvi kulkee taivaalla {i}", "fi") for i in tenth[20:23]]
            + [(None, "zażółć gęślą jaźń", "pl")])
    schema = "doc_id long, text string, lang string"
    m = langid_kn.train(spark.createDataFrame(rows, schema))
    assert m.langs == ["en", "fi", "pl"] and set(m.usual) == {"en"}
    asked = spark.createDataFrame([(1, "kulkee pilvi", ""), (2, "gęślą jaźń", ""),
                                   (3, "fine weather", "")], schema)
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid_kn.predict(asked, m).collect()}
    assert {d: l for d, (l, _) in got.items()} == {1: "fi", 2: "pl", 3: "en"}
    assert not got[1][1] and not got[2][1]
    only = [r for r in rows if r[2] != "en"]  # nothing to calibrate with
    m = langid_kn.train(spark.createDataFrame(only, schema))
    assert m.langs == ["fi", "pl"] and m.usual == {}


# ---- the pipeline's last stages -----------------------------------------------------


def test_shards_keep_the_mix(spark, tmp_out):
    import corpus_pipeline
    from pyspark.sql import functions as F
    from tests.llm.test_brute_force import deviation
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.range(6400).select(  # a hot source, and two small ones
        F.col("id").alias("doc_id"), F.expr("concat('text ', hash(id), repeat(' x', id % 50))").alias("text"),
        F.expr("CASE WHEN id % 16 = 0 THEN 'b' WHEN id % 16 = 1 THEN 'c' ELSE 'a' END").alias("source"))
    stages["mixing"](spark, docs, None).write.option("maxRecordsPerFile", 300).parquet(f"{tmp_out}/mix")
    mixed = spark.read.parquet(f"{tmp_out}/mix")
    want = [r["doc_id"] for r in stages["mixing"](spark, docs, None).collect()]
    out = stages["sharding"](spark, mixed, None)
    assert out.columns == [*docs.columns, "size", "shard"]
    rows = out.collect()
    assert [r["doc_id"] for r in rows] == want
    shards = [r["shard"] for r in rows]
    assert shards == sorted(shards) and set(shards) == set(range(16))
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 300  # a few rows
    weights = {"a": 5600 ** 0.5, "b": 20, "c": 20}
    first = [r["source"] for r in rows if r["shard"] == 0]
    assert deviation(first, weights) < 16 * 1.1  # rows of a block


# ---- mixing -------------------------------------------------------------------------


def worst(rows, weights):
    """Largest difference between a source's blocks and its target, until one runs out."""
    rows = sorted(rows, key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(rows)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    order = {r["slot"]: r["source"] for r in rows if r["phase"] == 0}
    total, count, most = sum(weights.values()), collections.Counter(), 0.0
    for t in range(len(order)):
        count[order[t]] += 1
        most = max(most, max(abs(count[s] - w * (t + 1) / total) for s, w in weights.items()))
    return most


def test_every_source_has_its_own_weight(spark):
    from pyspark.sql import functions as F
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"),
                                    F.expr("concat('s', id % 100)").alias("source"))
    rows = pfair_mix.mix_positions(docs, block_rows=1, lanes=2).collect()
    assert len({r["source_no"] for r in rows}) == 100
    assert worst(rows, {f"s{i}": 1 for i in range(100)}) < 2
    given = {f"s{i}": 0.016 if i >= 70 else 0.005 for i in range(90)}  # s90 to s99: the rest
    rows = pfair_mix.mix_positions(docs, given, block_rows=1, lanes=2, max_named=7).collect()
    assert len({r["source_no"] for r in rows}) == 91
    pooled = [r.asDict() | {"source": r["source"] if r["source"] in given else "rest"} for r in rows]
    assert worst(pooled, given | {"rest": 1 - sum(given.values())}) < 3
