"""Operators 11 to 13 against plain Python: whole tables, messy rows, hard cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tierspark.llm import best_fit_pack, prefix_trie, token_align
from tierspark.llm.vocab import WordIds, open_tokenizer, vocabulary

DOCS = "doc_id long, text string, own_group long, sequence_id string"
ODD = ["", "  ", "\n\t", "x" * 6000, "Ünïcode İstanbul ΣΑΣ ΟΔΟΣ", "<|endoftext|> <|ENDOFTEXT|> <s> </s>",
       "don't 12² ½ I'LL 'S", "a\x85b\xa0c\x1cd \x01 e", "é é ﬁ ①", "▁ x▁y", "日本語 テキスト",
       "a  b   c ", " lead", "tail ", "tab\t end\r\nline", "😀 emoji 😀😀", "  sep 　 wide"]


def messy(spark, texts):
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)]
    rows += [(None, "null id", 2, "clash"), (None, None, 2, "clash"), (3, "again", 1, "clash"),
             (3, "again", 1, "clash"), (-7, None, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


def plain_ids(texts):
    tok = open_tokenizer(vocabulary("word_bpe_49k.json"))
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def texts_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()


# ---- 11: packing ---------------------------------------------------------------------

def check_packing(rows, want, capacity):
    """Pieces cut as asked, sequences gapless and not too long; the number of sequences."""
    at = collections.defaultdict(list)
    for r in rows:
        ids = np.array(want[r["doc_id"]][r["start"]:r["start"] + capacity], "<u4")
        assert r["start"] == capacity * r["piece"] and r["length"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted((r["doc_id"], r["piece"]) for r in rows) == sorted(
        (d, k) for d, ids in want.items() for k in range(-(-len(ids) // capacity)))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_packing_of_the_whole_table(spark):
    docs = texts_of(spark, SF_SMALL)
    want = {r["doc_id"]: ids + [0] for r, ids in zip(docs, plain_ids([r["text"] or "" for r in docs]))}
    n = check_packing(best_fit_pack.op11_pack(spark, SF_SMALL).collect(), want, 2048)
    cut = [len(v[k:k + 2048]) for v in want.values() for k in range(0, len(v), 2048)]
    assert n <= best_fit_pack.fewest_bins(cut, 2048) + 1


def test_word_ids_equal_the_tokenizer():
    words = WordIds(vocabulary("word_bpe_49k.json"))
    rng = random.Random(4)
    made = ["".join(rng.choice("abcXYZ é'ß.,;!?19½\n-_<|>’Σ") for _ in range(rng.randint(0, 60)))
            for _ in range(600)]
    texts = ODD + made + ODD
    ids, ends = words.of(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == plain_ids(texts)


def test_forgetting_words_changes_nothing(monkeypatch):
    from tierspark.llm import vocab
    monkeypatch.setattr(vocab, "KEPT", 20)
    words, texts = WordIds(vocabulary("word_bpe_49k.json")), [f"word{i} and {i} more" for i in range(90)]
    for at in range(0, 90, 9):
        ids, ends = words.of(texts[at:at + 9])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == plain_ids(texts[at:at + 9])


def test_pieces_of_messy_rows(spark):
    df, rows = messy(spark, ODD + ["word " * 5000])
    pieces = best_fit_pack.token_pieces(df, with_ids=True).collect()
    want = collections.Counter()
    for r, ids in zip(rows, plain_ids([r[1] or "" for r in rows])):
        ids = ids + [0]
        want.update((r[0], k, tuple(ids[2048 * k:2048 * k + 2048])) for k in range(-(-len(ids) // 2048)))
    assert collections.Counter((p["doc_id"], p["piece"], tuple(p["ids"])) for p in pieces) == want
    assert len({p["number"] for p in pieces}) == len(pieces)


def test_packing_of_no_rows_and_of_clashing_columns(spark, tmp_path):
    df, rows = messy(spark, ODD)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert best_fit_pack.op11_pack(spark, f"{tmp_path}/none").collect() == []
    df.write.parquet(f"{tmp_path}/some/documents.parquet")
    got = best_fit_pack.op11_pack(spark, f"{tmp_path}/some").collect()
    assert len({r["sequence_id"] for r in got}) == -(-sum(r["length"] for r in got) // 2048)


def test_packing_in_rounds_of_small_groups(spark, tmp_path):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 2049, 900)] + [1100] * 50
    spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "number long, length long").write.parquet(
        f"{tmp_path}/p")
    got = best_fit_pack.pack(spark.read.parquet(f"{tmp_path}/p"), group_size=40).collect()
    assert sorted((r["number"], r["length"]) for r in got) == list(enumerate(sizes))
    fill = collections.Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    alone = best_fit_pack.pack_lengths(sizes, 2048)
    assert len(fill) <= 1.03 * len(alone)


def test_local_search_empties_bins_that_best_fit_leaves():
    # best fit decreasing needs three bins; two are enough after exchanges
    sizes = [46, 46, 37, 37, 17, 17]
    assert len(best_fit_pack.best_fit_decreasing(sizes, 100)) == 3
    bins = best_fit_pack.pack_lengths(sizes, 100)
    assert sorted(sorted(sizes[i] for i in b) for b in bins) == [[17, 37, 46], [17, 37, 46]]


def least_bins(sizes, capacity):
    """Fewest bins by trying everything (few documents only)."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best


def test_local_search_against_every_packing():
    rng, worse, gained = random.Random(8), 0, 0
    for _ in range(120):
        sizes = [rng.randint(12, 60) for _ in range(rng.randint(3, 9))]
        bins = best_fit_pack.pack_lengths(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        first = len(best_fit_pack.best_fit_decreasing(sizes, 100))
        assert best_fit_pack.fewest_bins(sizes, 100) <= least_bins(sizes, 100) <= len(bins) <= first
        gained += first - len(bins)
        worse += len(bins) > least_bins(sizes, 100)
    assert worse <= 2 and gained >= 1


def test_every_step_raises_the_sum_of_squared_fills():
    rng = random.Random(3)
    sizes = [rng.randint(200, 900) for _ in range(160)]
    bins = dict(enumerate(best_fit_pack.best_fit_decreasing(sizes, 2048)))
    under = best_fit_pack._Underfull(bins, sizes, 2048)
    for s in sorted(under.bins, key=lambda b: under.fill[b])[:10]:
        step = under.best_step(s)
        if step:
            gain, given, n, t, back, m = step
            before = under.fill[s] ** 2 + under.fill[t] ** 2
            d = given - back
            assert (under.fill[s] - d) ** 2 + (under.fill[t] + d) ** 2 - before == 2 * gain > 0
            assert under.fill[t] + d <= 2048 and (n, m) in {(1, 0), (1, 1), (2, 1), (1, 2)}


# ---- 12: prefix trie -----------------------------------------------------------------

def plain_trie(rows):
    """Nodes by brute force: every prefix of every rebuilt conversation."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, key), (role or "", text or "")))
    own = {c: [x for _, x in sorted(t, key=lambda y: y[0])] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p],
                    saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*TRIE).collect()), key=str)


def test_trie_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()
    assert trie_rows(prefix_trie.op12_prefix_trie(spark, SF_SMALL)) == plain_trie(rows)


@pytest.mark.parametrize("shard_ids", [100, 1000])
def test_trie_of_messy_rows_in_many_shards(spark, shard_ids):
    rng = random.Random(shard_ids)
    rows = []
    for c in list(range(0, 700, 3)) + [-205, -200, -1, 5_000_000_107, 9100]:
        turns = [("user", "hello"), ("assistant", "same answer")] if c % 2 else []
        turns += [(rng.choice(["user", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randint(0, 6))]
        turns = turns or [("user", None)]
        rows += [(c, rng.choice([None, i, i // 2]), r, t) for i, (r, t) in enumerate(turns)]
    rows += rows[:9] + [(None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(600, i, "user", "deep" * (i % 3)) for i in range(300)]        # a deep chain
    rows += [(603, i, "user", "deep" * (i % 3)) for i in range(0, 290)]
    rows += [(12, 3, "user", "long " * 40_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, node string, shard int")
    assert trie_rows(prefix_trie.prefix_trie(df, shard_ids)) == plain_trie(rows)


def test_trie_of_one_common_conversation_and_of_none(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 2500) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie_rows(prefix_trie.prefix_trie(df, 100))
    assert got == plain_trie(rows) and len(got) == 7 and got[0][3] == 2500
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


# ---- 13: alignment -------------------------------------------------------------------

def plain_alignment(texts):
    """Digests of each text by whole encodings and all pairs of overlapping tokens."""
    v = token_align.Vocabularies(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    tok = open_tokenizer(vocabulary("byte_bpe_50k.json"), plain_specials=True)
    found, counts = [], collections.Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = v.b.encode(t or "")
        if not t or b"".join(v.a_bytes[i] for i in a) != raw or b"".join(v.b_bytes[i] for i in b) != raw:
            found.append(None)
            continue
        ends = [np.cumsum([len(of[i]) for i in ids]) for of, ids in ((v.a_bytes, a), (v.b_bytes, b))]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        links = []
        for i, x in enumerate(a):
            first = int(np.searchsorted(ends[1], starts[0][i], "right"))
            last = int(np.searchsorted(starts[1], ends[0][i], "left"))
            links += [(x, b[j]) for j in range(first, last)]
        cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        groups, i, j = [], 0, 0
        for cut in cuts:
            m, n = (int(np.searchsorted(e, cut, "right")) for e in ends)
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        found.append((a, b, groups, links))
        counts.update(set(links))
    top = collections.defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counts[x] == top[x[0]] for x in f[3]),
             sum(counts[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
            for f in found]


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_the_whole_table(spark):
    docs = texts_of(spark, SF_SMALL)
    got = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in token_align.op13_align(spark, SF_SMALL).collect()}
    assert got == dict(zip([r["doc_id"] for r in docs], plain_alignment([r["text"] for r in docs])))


def test_alignment_of_messy_rows(spark):
    df, rows = messy(spark, ODD + ["word " * 3000, "aaaa" * 900, "  \n  mixed \n\n blank  runs  "])
    got = token_align.align(df.repartition(3)).collect()
    want = collections.Counter(zip([r[0] for r in rows], plain_alignment([r[1] for r in rows])))
    assert collections.Counter((r["doc_id"], tuple(r[c] for c in ALIGNED)) for r in got) == want
    assert token_align.align(df.limit(0)).collect() == []


def test_alignment_does_not_depend_on_chunks_or_on_what_is_kept(spark, monkeypatch):
    texts = [f"sentence {i} with a fewß words, and {i * i} numbers" for i in range(120)]
    want = [(i, *x) for i, x in enumerate(plain_alignment(texts))]
    v = token_align.Vocabularies(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    monkeypatch.setattr(token_align, "KEPT_SEGMENTS", 50)
    segments, sums = token_align.Segments(v), []
    for at in range(0, 120, 7):
        chunk = token_align._Chunk(segments, texts[at:at + 7])
        sums += [(int(a), int(b), int(g), int(n), d) for (a, b, g, n), d in zip(chunk.sums, chunk.digests)]
    assert sums == [(a, b, g, n, d) for _, a, b, g, n, _, _, d in want]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 5):
        got = token_align.align(df.repartition(parts)).select("doc_id", *ALIGNED).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == want


def test_identity_pairs_stay_out_of_the_pair_shuffle(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    linked = token_align.linked_documents(docs)
    v = token_align.Vocabularies(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    size = len(v.b_bytes)
    same, other = token_align.pair_counts(linked, size)
    codes = [r["code"] for r in other.collect()]
    assert codes and all(v.identity[c // size] != c % size for c in codes)
    assert all(v.identity[r["a"]] >= 0 for r in same.collect())
    assert same.agg(F.max("docs")).first()[0] <= docs.count()
