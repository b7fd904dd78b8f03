"""Secret scan with corpus-wide ownership frequency.

Base patterns (assigned secrets, access keys, long hex strings) are found in the whole
text by SQL functions alone: splitting at a pattern gives the gaps, extracting it gives
the matches, and their lengths give the positions. Vendor-shaped tokens are a further
kind. The hashes of all candidates are counted over the corpus by distinct repository
and owner. A value held by more than ``max_owners`` owners, or shaped like a placeholder,
is a copied example; the others look live. Vendor tokens are reported only if they look
live; base matches are always reported, with their class beside them.

Owner and repository come from the source: ``owner/repository``, or the whole source for
both if it has no slash.

Defined cases
* null text counts as empty; no match gives counts of 0 and empty strings.
* a null source is an owner of its own.
* rows repeating a ``doc_id`` each get their own result row.
* matches of one text are placed in time proportional to their number, texts of any
  length are scanned whole; spans that start together are listed by kind.
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, whole_text

# The patterns of the contract; length limits of long runs are inside them
# (a greedy run that is too short has no longer match within it).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
VENDOR = (r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}"
          r"|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})")
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|your|xxxx|1234567|<|\*\*\*"
#: Matches of a text whose positions are added up in one go.
CHUNK = 256
KINDS = ["assign", "access", "hex", "vendor"]


def _spans(pattern: str, kind: int, group: int, least: int):
    """array<struct(s, k, e, v)> of the pattern's matches in column t."""
    t = F.col("t")
    gaps, whole = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("m"), value.alias("v"))
    steps = F.transform(zipped, lambda x: F.struct(
        F.char_length(x["gap"]).alias("g"), F.char_length(x["m"]).alias("m"), x["v"].alias("v")))
    none = F.coalesce(F.lit(None).cast("array<struct<s:int,k:int,e:int,v:string>>"), F.array())

    def within(chunk, first):
        """The spans of one chunk of matches, the first gap of which begins at ``first``."""
        def step(acc, x):
            s = acc["at"] + x["g"]
            span = F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + x["m"]).alias("e"), x["v"].alias("v"))
            return F.struct((s + x["m"]).alias("at"), F.when(
                F.char_length(x["v"]) >= least, F.concat(acc["out"], F.array(span)))
                .otherwise(acc["out"]).alias("out"))
        return F.aggregate(chunk, F.struct(first.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def all_chunks(chunks):
        """Each chunk's start is the sum of the lengths before it."""
        starts = F.aggregate(
            chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, c: F.struct(
                (acc["at"] + F.aggregate(c, F.lit(0), lambda n, x: n + x["g"] + x["m"])).alias("at"),
                F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), starts.alias("s")),
                                     lambda z: within(z["c"], z["s"])))

    def cut(all_steps):
        """Matches in chunks of CHUNK: an array grows by copying, so a long one is never
        built match by match."""
        last = F.floor((F.size(all_steps) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                           lambda c: F.slice(all_steps, c * CHUNK + 1, CHUNK))

    # bound once each, so that the patterns are matched once
    chunks = F.transform(F.array(steps), cut)
    return F.when(t.rlike(pattern), F.transform(chunks, all_chunks)[0]).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), owner, repo, spans (sorted by start, then kind)."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"),
                    F.col("source").cast("string").alias("repo"))
    spans = F.concat(_spans(ASSIGN, 0, 2, 8), _spans(ACCESS, 1, 0, 16), _spans(HEX, 2, 0, 32),
                     _spans(VENDOR, 3, 0, 10))
    return t.select("doc_id", F.xxhash64("t").alias("th"), "repo",
                    F.substring_index("repo", "/", 1).alias("owner"),
                    F.sort_array(spans).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(h1, h2, owners, repos): distinct owners and repositories of each value."""
    rows = found.where(F.size("spans") > 0).select("owner", "repo", F.explode("spans.v").alias("v"))
    each = rows.select(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("value"), "v").alias("h2"),
                       F.coalesce("owner", F.lit("\0")).alias("owner"),
                       F.coalesce("repo", F.lit("\0")).alias("repo")).distinct()
    owned = each.groupBy("h1", "h2", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owned.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("owners"),
                                         F.sum("repos").alias("repos"))


def _text_of(spans: str, owned: bool = False):
    """kind:start:end of an array of spans, comma-joined; ``owned``: followed by
    :owners:repositories:class."""
    more = ", ':', x.owners, ':', x.repos, if(x.live, ':live', ':example')" if owned else ""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> "
                  f"concat({kinds}[x.k], ':', x.s, ':', x.e{more})), ',')")


def scan(docs: DataFrame, max_owners: int = 2) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans, n_live, n_example and ownership: for
    each candidate its span, the numbers of distinct owners and repositories that hold the
    value, and its class."""
    found = materialize(candidates(docs), "secret-candidates")
    owners = materialize(ownership(found), "secret-owners")
    some = found.where(F.size("spans") > 0).select("doc_id", "th", F.explode("spans").alias("x"))
    some = some.select("doc_id", "th", "x", F.xxhash64("x.v").alias("h1"),
                       F.xxhash64(F.lit("value"), F.col("x.v")).alias("h2")).distinct()
    live = (F.col("owners") <= max_owners) & ~F.col("x.v").rlike(PLACEHOLDER)
    judged = some.join(owners, ["h1", "h2"]).withColumn("live", live)
    by_doc = judged.groupBy("doc_id", "th").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"),
        F.sort_array(F.collect_list(F.when((F.col("x.k") < 3) | F.col("live"), F.col("x"))))
        .alias("shown"), F.sort_array(F.collect_list(F.struct(
            "x.s", "x.k", "x.e", "owners", "repos", "live"))).alias("owned"))
    none = found.where(F.size("spans") == 0).select(
        "doc_id", "spans", F.lit(0).cast("long").alias("n_live"),
        F.lit(0).cast("long").alias("n_example"), F.col("spans").alias("shown"),
        F.lit("").alias("ownership"))
    with_ = found.where(F.size("spans") > 0).alias("f").join(
        by_doc.alias("b"), F.col("f.doc_id").eqNullSafe(F.col("b.doc_id"))
        & (F.col("f.th") == F.col("b.th"))).select("f.doc_id", "spans", "n_live", "n_example",
                                                   "shown", _text_of("owned", True).alias("ownership"))
    both = none.unionByName(with_).withColumn("base", F.expr("filter(spans, x -> x.k < 3)"))
    counts = [F.expr(f"size(filter(base, x -> x.k = {k}))").cast("long").alias(f"n_{KINDS[k]}")
              for k in range(3)]
    return both.select("doc_id", *counts, _text_of("base").alias("base"),
                       _text_of("shown").alias("spans"), "n_live", "n_example", "ownership")


def op6_secrets(spark, sf_dir):
    """Secrets of all ``documents``, and what their ownership over the corpus says. Nulls,
    ties, repeated rows, long texts and an empty table: see the head of this module."""
    r = scan(documents(spark, sf_dir))
    return r.select("doc_id", "n_assign", "n_access", "n_hex",
                    F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
                    "n_live", "n_example", "ownership")


def _duck_spans(pattern: str, kind: int, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {kind} AS k, s, s + length(m) AS e, v FROM (
  SELECT doc_id, m, v, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i)
                        - length(m))::BIGINT AS s
  FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v,
               unnest(string_split_regex(t, '{p}')[1:len(m)]) AS gap
        FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m,
                     regexp_extract_all(t, '{p}', {group}) AS v FROM docs)))
WHERE length(v) >= {least}"""


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join([_duck_spans(ASSIGN, 0, 2, 8), _duck_spans(ACCESS, 1, 0, 16),
                               _duck_spans("[0-9a-f]{32,}", 2, 0, 32),
                               _duck_spans(VENDOR, 3, 0, 10)])}),
owners AS (SELECT v, count(DISTINCT coalesce(split_part(source, '/', 1), chr(1))) AS owners,
                  count(DISTINCT coalesce(source, chr(1))) AS repos
           FROM found JOIN documents USING (doc_id) GROUP BY v),
shown AS (SELECT f.*, owners, repos, owners <= 2 AND NOT regexp_matches(v, '{PLACEHOLDER}') AS live,
                 k < 3 OR (owners <= 2 AND NOT regexp_matches(v, '{PLACEHOLDER}')) AS listed,
                 ['assign', 'access', 'hex', 'vendor'][k + 1] || ':' || s || ':' || e AS txt
          FROM found f JOIN owners USING (v))
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
       count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(txt, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
       coalesce(string_agg(txt, ',' ORDER BY s, k) FILTER (listed), '') AS spans,
       count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example,
       coalesce(string_agg(txt || ':' || owners || ':' || repos || CASE WHEN live THEN ':live' ELSE ':example' END,
                           ',' ORDER BY s, k), '') AS ownership
FROM docs d LEFT JOIN shown USING (doc_id) GROUP BY d.doc_id
"""
