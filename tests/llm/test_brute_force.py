"""Suffix dedup, SimHash groups, decontamination, sharding and mixing against brute force."""

import collections
import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm import messy
from tierspark.llm import (decontaminate, deep_shallow, histogram_shard, pfair_mix, simhash_dedup,
                           suffix_dedup)
from tierspark.llm.common import documents


def key(r):
    return tuple(map(repr, r))


# ---- suffix dedup -------------------------------------------------------------------


def cut_by_hand(texts, span):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p:p + span] for b in data for p in range(len(b) - span + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if count[b[p:p + span]] > 1:
                gone[p:p + span] = b"\1" * span
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed(docs, **kw):
    r = suffix_dedup.remove_repeats(docs, **kw)
    return sorted(map(tuple, r.select("doc_id", "n_bytes", "n_removed", "n_spans",
                                      F.sha2("kept", 256)).collect()), key=key)


def test_repeats_of_a_whole_table(spark):
    rows = documents(spark, SF_SMALL).select("doc_id", "text").collect()
    want = [(r["doc_id"], *w) for r, w in zip(rows, cut_by_hand([r["text"] for r in rows], 400))]
    got = [tuple(r) for r in suffix_dedup.op4_suffix(spark, SF_SMALL).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("span,split", [(400, 256), (100, 256), (100, 1), (70, 3)])
def test_repeats_of_messy_documents(spark, span, split):
    rows = messy.rows()
    want = [(r[0], *w) for r, w in zip(rows, cut_by_hand([r[1] for r in rows], span))]
    assert removed(messy.docs(spark), span=span, split=split) == sorted(want, key=key)


def test_a_frequent_passage_below_the_span_is_dealt_out(spark):
    rng = random.Random(6)

    def noise(n):
        return "".join(rng.choice("abcdefghij") for _ in range(n))

    passage = noise(300)
    rows = [(i, noise(500) + passage + noise(500)) for i in range(400)]
    rows += [(1000 + i, noise(300) + rows[i][1][450:950] + noise(300)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = [(r[0], *w) for r, w in zip(rows, cut_by_hand([r[1] for r in rows], 400))]
    assert removed(df, span=400, split=64) == sorted(want, key=key)
    slices = []
    for _, text in rows[:400]:
        for lo, hi, p, h in suffix_dedup.runs(text.encode(), 400):
            slices.append((h, 0, -1, 0, 0, p - lo, True, text.encode()[lo:hi + 400]))
    per_anchor = collections.Counter(s[0] for s in slices)
    hot = [s for s in slices if per_anchor[s[0]] > 64]
    assert hot and max(per_anchor.values()) >= 250
    parts = list(suffix_dedup._parts(400)(iter([suffix_dedup._to_batch(hot, suffix_dedup.SLICE)])))
    met = collections.Counter(zip(*(sum((b.column(c).to_pylist() for b in parts), [])
                                    for c in ("h", "part", "from_a"))))
    assert max(met.values()) <= 2


def test_stretches_with_one_digest_are_compared_on_bytes(spark):
    text = "".join(random.Random(9).choice("abcdef") for _ in range(3000))
    rows = [(1, text), (2, "front " + text), (3, text[:1500] + "#" + text[1501:])]
    texts = suffix_dedup._texts(spark.createDataFrame(rows, "doc_id long, text string"))
    th = {r["d"]: r["th"] for r in texts.collect()}
    fields = "d long, th long, lo long, hi long, off long, h long, u long, v long, n long, kinds long"

    def found(second, by):
        return spark.createDataFrame(
            [(d, th[d], lo + by * (d != 1), lo + 99 + by * (d != 1), 5, 7, lo, lo, 2, 1)
             for lo in range(0, 2000, 100) for d in (1, second)], fields)

    assert suffix_dedup.compare_stretches(texts, found(2, 6), 400).collect() == []
    odd = suffix_dedup.compare_stretches(texts, found(3, 0), 400).collect()
    assert [r["common"] for r in odd] == [1500]


def test_spans_and_text_of_op4(spark):
    for r in suffix_dedup.op4_suffix(spark, SF_SMALL).where("n_removed > 0").collect():
        spans = [tuple(map(int, x.split(":"))) for x in r["spans"].split(",")]
        assert len(spans) == r["n_spans"] and sum(b - a for a, b in spans) == r["n_removed"]
        if "\ufffd" not in r["text"]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


def test_no_documents(spark):
    assert removed(messy.no_docs(spark)) == []


def test_deep_shallow_order_and_common_prefixes():
    from os.path import commonprefix
    random.seed(1)
    for _ in range(300):
        base = bytes(random.choice(b"ab") for _ in range(60))
        s = [base[:random.randint(0, 60)] + bytes(random.choice(b"abc") for _ in range(
            random.randint(0, 20))) for _ in range(random.randint(1, 12))]
        order, common = deep_shallow.deep_shallow(s, 0, random.choice([0, 1, 4, 16]))
        assert [s[i] for i in order] == sorted(s)
        assert common[1:] == [len(commonprefix([s[a], s[b]])) for a, b in zip(order, order[1:])]


def test_both_forms_of_the_bucket_step_agree():
    random.seed(4)
    for _ in range(60):
        pool = [bytes(random.choice(b"ab") for _ in range(40)) for _ in range(3)]
        runs = []
        for _ in range(random.randint(2, 12)):
            left = random.choice(pool)[:random.randint(0, 24)]
            right = random.choice(pool)[:random.randint(26, 40)] + random.choice([b"", b"x", b"y"])
            runs.append((len(left), left + right))
        left = deep_shallow.deep_shallow([c[:o][::-1] for o, c in runs])
        right = deep_shallow.deep_shallow([c[o:] for o, c in runs])
        a = suffix_dedup._by_pairs(left, right, 30)
        b = suffix_dedup._by_classes(left, right, 30, max(o for o, _ in runs))
        flat = [[{x for lo, hi in own for x in range(lo, hi + 1)} for own in f] for f in (a, b)]
        assert flat[0] == flat[1]


# ---- simhash ------------------------------------------------------------------------


def fingerprint(text, n=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i:i + n]).encode(), seed=42).intdigest()
         for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, bits=2):
    big = float("inf")
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = collections.defaultdict(lambda: big)
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], big if d is None else d)
    return [None if least[find(i)] == big else least[find(i)] for i in range(len(fps))]


def test_simhash_of_a_whole_table(spark):
    rows = documents(spark, SF_SMALL).select("doc_id", "text").collect()
    fps = [fingerprint(r["text"]) for r in rows]
    want = [(r["doc_id"], f"{f:016x}", c) for r, f, c in
            zip(rows, fps, components(fps, [r["doc_id"] for r in rows]))]
    got = simhash_dedup.op10_simhash(spark, SF_SMALL).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_simhash_of_messy_documents(spark):
    rows = messy.rows()
    fps = [fingerprint(r[1]) for r in rows]
    comp = components(fps, [r[0] for r in rows])
    got = simhash_dedup.near_groups(messy.docs(spark)).select(
        simhash_dedup.id_of("d"), F.hex("fp"), simhash_dedup.id_of("component")).collect()
    want = [(r[0], f"{f:X}", c) for r, f, c in zip(rows, fps, comp)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = simhash_dedup.keep_one_of_each_group(messy.docs(spark))
    assert kept.columns == messy.docs(spark).columns
    want_kept = sorted((r for r, c in zip(rows, comp) if r[0] == c), key=key)
    assert sorted(map(tuple, kept.collect()), key=key) == want_kept


@pytest.mark.parametrize("layout", [
    [(list(range(0, 21)), 0), (list(range(21, 42)), 0), (list(range(42, 64)), 0)],
    [(list(range(0, 64, 2)), 1), (list(range(1, 64, 2)), 0)],
    [(list(range(0, 16)), 2), (list(range(16, 64)), -1)][:1] + [(list(range(16, 64)), -1)],
    [(list(range(64)), 2)],
])
@pytest.mark.parametrize("crowd", [1, 32])
def test_no_link_is_lost_by_any_plan_or_crowd(spark, layout, crowd):
    random.seed(7)
    base = [random.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(random.randint(1, 4)):
                x ^= 1 << random.randrange(64)
            fps.add(x)
    # 2 bits in the first 16 alone cannot be promised by the third layout
    if layout[-1][1] == -1:
        fps = {f & 0xFFFF for f in fps}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = [tuple(r) for r in simhash_dedup.links(df, layout, 2, crowd).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in edges)
    roots = {r["fp"]: r["root"] for r in simhash_dedup.components(
        spark.createDataFrame(edges, "a long, b long")).collect()} if edges else {}
    got = collections.defaultdict(set)
    for s in signed:
        got[roots.get(s, s)].add(s)
    want = collections.defaultdict(set)
    for s, c in zip(signed, components(fps, list(range(len(fps))))):
        want[c].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds_are_the_cheapest():
    cost = [{-1: 0, 0: 5, 1: 9, 2: 50}, {-1: 0, 0: 1, 1: 30, 2: 90}, {-1: 0, 0: 7, 1: 8, 2: 60}]
    total, ts = simhash_dedup.best_thresholds(cost, 3)
    every = [(sum(c[t] for c, t in zip(cost, p)), p) for p in
             __import__("itertools").product(range(-1, 3), repeat=3) if sum(t + 1 for t in p) == 3]
    assert total == min(every)[0] and sum(t + 1 for t in ts) == 3


def test_long_chains_settle(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    random.seed(1)
    random.shuffle(edges)
    got = {r["fp"]: r["root"] for r in simhash_dedup.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 301)} == {0} and got[1001] == 1000


# ---- decontamination ----------------------------------------------------------------


def align(item, passage):
    """Textbook Smith-Waterman."""
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            s = 2 if item[i - 1] == passage[j - 1] else -2
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - 2, h[i][j - 1] - 2)
            best = max(best, h[i][j])
    return best


def test_smith_waterman():
    import numpy as np
    random.seed(3)
    for _ in range(60):
        a = [random.randrange(4) + 1 for _ in range(random.randint(1, 14))]
        b = [random.randrange(5) for _ in range(random.randint(1, 30))]
        score, lo, hi = decontaminate.smith_waterman(np.array(a), np.array(b))
        assert score == align(a, b)
        if score:
            assert align(a, b[lo:hi]) == score


def test_leaks_of_a_whole_table(spark):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op9_decontaminate(spark, SF_SMALL).collect()}
    items = [(r["item_id"], decontaminate.words(r["text"])) for r in
             spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    want = set()
    for r in documents(spark, SF_SMALL).collect():
        w = decontaminate.words(r["text"])
        for i, item in items:
            if len(item) >= 8 and set(zip(item, item[1:], item[2:])) & set(zip(w, w[1:], w[2:])):
                score = align(item, w)
                if score >= len(item) or score >= 40:
                    want.add((r["doc_id"], i))
    assert got == want and want


def edited(text, rate, seed):
    random.seed(seed)
    out = []
    for w in text.split():
        x = random.random()
        out += [] if x < rate / 3 else [w, "inserted"] if x < 2 * rate / 3 else \
            ["replaced"] if x < rate else [w]
    return " ".join(out)


def test_edited_copies_are_found_and_clean_texts_are_not(spark):
    items = [(i, messy.prose(100 + i, 40)) for i in range(5)]
    bench = spark.createDataFrame([*items, (7, None), (8, "too short"), (9, "")],
                                  "item_id long, text string")
    rows = [(i, messy.prose(500 + i, 200) + ". " + edited(t, 0.15, i).upper() + "! " + messy.prose(
        900 + i, 100)) for i, t in items]
    rows += [(100 + i, messy.prose(2000 + i, 300)) for i in range(5)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(i, i) for i in range(5)}
    kept = decontaminate.drop_leaks(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [100, 101, 102, 103, 104, 200, 201]
    few = decontaminate.leaks(docs, bench, block_bytes=200)  # several rounds
    assert {(r["doc_id"], r["item_id"]) for r in few.collect()} == got
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == []


def test_an_item_copied_everywhere_is_still_found(spark):
    item = messy.prose(100, 40)
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    docs = spark.createDataFrame([(i, f"{i} {item} {i}") for i in range(60)], "doc_id long, text string")
    assert decontaminate.leaks(docs, bench, rare_share=0.0).count() == 60


def test_leaks_of_messy_documents(spark):
    bench = spark.createDataFrame([(1, messy.rows()[25][1]), (None, messy.prose(1, 60))],
                                  "item_id int, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(
        messy.docs(spark), bench).collect()), key=str)
    assert got == sorted([(8, 1), (9, 1), (22, 1), (22, 1), (23, 1), (8, None)], key=str)
    kept = decontaminate.drop_leaks(messy.docs(spark), bench)
    assert kept.columns == messy.docs(spark).columns
    assert kept.count() == len(messy.rows()) - 5
    assert decontaminate.drop_leaks(messy.no_docs(spark), bench).collect() == []


# ---- sharding -----------------------------------------------------------------------


def check_shards(rows, shards, largest):
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(size.values()) / shards
    assert all(abs(size[i] - mean) <= largest + 0.01 * mean + 1 for i in range(shards))


def test_shards_of_a_whole_table(spark):
    rows = histogram_shard.op8_histogram_shard(spark, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF_SMALL).collect()}
    import zlib
    for r in rows:
        b = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (
            len(b) + 1, zlib.crc32(b), "bytes", None)
    assert len(rows) == len(texts)
    check_shards(rows, 16, max(r["size"] for r in rows))
    home = collections.defaultdict(set)
    for r in rows:
        home[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in home.values()) <= 15


def test_a_group_larger_than_a_shard_is_split_by_id(spark):
    rows = [(i, "the same text") for i in range(600)] + [(i, messy.prose(i, 3)) for i in range(600, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = histogram_shard.shard_index(docs, shards=8, lanes=4).collect()
    check_shards(got, 8, 14)


def test_shards_of_messy_documents(spark):
    d = messy.docs(spark)
    rows = histogram_shard.shard_index(d, shards=4, lanes=3).collect()
    assert len(rows) == len(messy.rows())
    check_shards(rows, 4, max(r["size"] for r in rows))
    out = histogram_shard.assign_shards(d, shards=4)
    assert out.columns == [c for c in d.columns if c not in ("size", "shard")] + ["size", "shard"]
    assert collections.Counter((r["doc_id"], r["size"], r["shard"]) for r in out.collect()) == \
        collections.Counter((r["doc_id"], r["size"], r["shard"]) for r in rows)
    assert histogram_shard.shard_index(messy.no_docs(spark)).collect() == []
    assert histogram_shard.assign_shards(messy.no_docs(spark)).collect() == []


def test_partitions_of_shards_follow_the_bytes(spark):
    from tierspark.llm.common import bytes_setting
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        assert bytes_setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes") == 65536
        out = histogram_shard.assign_shards(documents(spark, SF_SMALL), shards=2)
        n = out.select(F.spark_partition_id().alias("p"), "shard").distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len({r["p"] for r in n}) >= 6
    order = [r["shard"] for r in sorted(n, key=lambda r: (r["p"], r["shard"]))]
    assert order == sorted(order)


def test_shards_are_exchanged_once(spark):
    plan = histogram_shard.assign_shards(documents(spark, SF_SMALL))._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan


# ---- mixing -------------------------------------------------------------------------


def deviation(order, weights):
    """Largest difference between blocks placed and the target, over all prefixes."""
    total, count, worst = sum(weights.values()), collections.Counter(), 0.0
    for t, n in enumerate(order, 1):
        count[n] += 1
        worst = max(worst, max(abs(count[k] - w * t / total) for k, w in weights.items()))
    return worst


def test_cycles_stay_within_a_block(spark):
    random.seed(5)
    for weights in ({0: 1}, {0: 5, 1: 1}, {0: 300, 1: 200, 2: 37, 3: 13, 4: 450},
                    {i: random.randint(1, 60) for i in range(20)}):
        order = pfair_mix.cycle(weights, spark)
        assert collections.Counter(order) == weights
        assert deviation(order * 2, weights) < 1


def check_mix(rows, block_rows):
    rows = sorted(rows, key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(rows)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r["slot"], (r["phase"], r["source_no"]))
    assert sorted(slots) == list(range(len(slots)))
    phases = collections.defaultdict(list)
    for s in sorted(slots):
        phases[slots[s][0]].append(slots[s][1])
    return phases


def test_mix_of_a_whole_table(spark):
    docs = documents(spark, SF_SMALL)
    weights = {"src0": 0.5, "src1": 0.2, "src2": 0.1}
    rows = pfair_mix.mix_positions(docs, weights, block_rows=2, lanes=8).collect()
    assert len(rows) == docs.count()
    phases = check_mix(rows, 2)
    assert deviation(phases[0], {0: 500, 1: 200, 2: 100, 3: 200}) < 1
    assert len(pfair_mix.op3_mix(spark, SF_SMALL).collect()) == docs.count()


def test_mix_of_messy_documents(spark):
    d = messy.docs(spark)
    check_mix(pfair_mix.mix_positions(d, block_rows=3, lanes=2, max_named=2).collect(), 3)
    out = pfair_mix.mix(d, block_rows=3, lanes=2)
    assert out.columns == d.columns
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, d.collect()), key=key)
    assert pfair_mix.mix(messy.no_docs(spark)).collect() == []
    nobody = d.withColumn("source", F.lit(None).cast("string"))
    check_mix(pfair_mix.mix_positions(nobody, block_rows=4).collect(), 4)
