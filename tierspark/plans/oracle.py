"""Equivalent DuckDB SQL for the registered queries.

The SQL restates each query from the raw tables (pre-registered views
``customer``, ``events``, ``part``, ``lineitem``, ...). Numbers stay in DOUBLE;
means are rounded where the summation order differs between engines.
"""

from __future__ import annotations

from tierspark.schemas import DEFAULT_RULES, FEATURES, NORM_FEATURES

ROUND = 9  # decimals for means whose summation order differs between engines

# ---- views ---------------------------------------------------------------------

_CE = {
    "manifest": """
  SELECT CAST(c_custkey AS VARCHAR) AS path,
         CAST(1672531200 + c_custkey * 1800 AS DOUBLE) AS creation_epoch,
         'dn' || CAST(c_nationkey % 3 + 1 AS VARCHAR) AS primary_node
  FROM customer""",
    "log": """
  SELECT CAST(user_id AS VARCHAR) AS path,
         epoch(ts) AS ts_epoch,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'WRITE'
              WHEN event_type IN ('view', 'click') THEN 'READ'
              WHEN event_type = 'error' THEN 'DELETE' END AS op,
         'dn' || CAST(event_id % 3 + 1 AS VARCHAR) AS client_node
  FROM events""",
    "manifest_text": """
  SELECT CAST(c_custkey AS VARCHAR) AS path,
         strftime(make_timestamp((1672531200 + c_custkey * 1800) * 1000000
                                 + (c_custkey % 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS creation_ts,
         'dn' || CAST(c_nationkey % 3 + 1 AS VARCHAR) AS primary_node,
         CAST(1024 * (c_custkey + 1) AS VARCHAR) AS size_bytes,
         lower(c_mktsegment) AS category
  FROM customer""",
    "log_text": """
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts_iso,
         CAST(user_id AS VARCHAR) AS path,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'WRITE'
              WHEN event_type IN ('view', 'click') THEN 'READ'
              WHEN event_type = 'error' THEN 'DELETE' END AS op,
         'dn' || CAST(event_id % 3 + 1 AS VARCHAR) AS client_node,
         CAST(1000 + event_id % 9000 AS VARCHAR) AS pid
  FROM events""",
    "width": 3600.0,
}

_PL = {
    "manifest": """
  SELECT CAST(p_partkey AS VARCHAR) AS path,
         CAST(757382400 + p_partkey * 1000 AS DOUBLE) AS creation_epoch,
         'dn' || CAST(p_partkey % 3 + 1 AS VARCHAR) AS primary_node
  FROM part""",
    "log": """
  SELECT CAST(l_partkey AS VARCHAR) AS path,
         epoch(l_shipdate) AS ts_epoch,
         CASE WHEN l_returnflag = 'A' THEN 'WRITE'
              WHEN l_returnflag = 'N' THEN 'READ'
              WHEN l_returnflag = 'R' THEN 'DELETE' END AS op,
         'dn' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS client_node
  FROM lineitem""",
    "width": 86400.0,
}

_SE = {
    "manifest": """
  SELECT CAST(s_suppkey AS VARCHAR) AS path, CAST(1672531200 AS DOUBLE) AS creation_epoch,
         'dn' || CAST(s_nationkey % 3 + 1 AS VARCHAR) AS primary_node
  FROM supplier""",
    "log": _CE["log"],
    "width": 3600.0,
}

_EDGES = {
    "manifest": """
  SELECT CAST(c_custkey AS VARCHAR) AS path,
         CASE WHEN c_mktsegment <> 'BUILDING'
              THEN CAST(1672531200 + c_custkey * 1800 AS DOUBLE) END AS creation_epoch,
         CASE WHEN c_mktsegment <> 'MACHINERY'
              THEN 'dn' || CAST(c_nationkey % 3 + 1 AS VARCHAR) END AS primary_node
  FROM customer""",
    "log": """
  SELECT CAST(user_id AS VARCHAR) AS path,
         CASE WHEN event_type <> 'error' THEN epoch(ts) END AS ts_epoch,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'WRITE'
              WHEN event_type IN ('view', 'click') THEN 'READ'
              WHEN event_type = 'error' THEN 'DELETE' END AS op,
         CASE WHEN event_type <> 'signup'
              THEN 'dn' || CAST(event_id % 3 + 1 AS VARCHAR) END AS client_node
  FROM events""",
    "width": 3600.0,
}

_NO_LOG = {"manifest": _CE["manifest"], "log": _CE["log"] + " WHERE false", "width": 3600.0,
           "end": "SELECT CAST(1800000000 AS DOUBLE) AS observation_end"}

VIEWS = {"customer_events": _CE, "part_lineitem": _PL, "supplier_events": _SE, "edges": _EDGES,
         "no_log": _NO_LOG}


def _with(view: dict, *ctes: tuple) -> str:
    parts = [f"manifest AS ({view['manifest']})", f"log AS ({view['log']})"]
    parts += [f"{name} AS ({body})" for name, body in ctes]
    return "WITH " + ",\n".join(parts) + "\n"


# ---- feature chain ---------------------------------------------------------------

def _feature_ctes(view: dict) -> list:
    w = view["width"]
    return [
        ("path_stats", """
  SELECT path, count(*) AS access_freq,
         CAST(sum(CASE WHEN op = 'WRITE' THEN 1 ELSE 0 END) AS BIGINT) AS writes,
         CAST(sum(CASE WHEN op = 'READ' THEN 1 ELSE 0 END) AS BIGINT) AS reads
  FROM log GROUP BY path"""),
        ("buckets", f"""
  SELECT path, CAST(floor(ts_epoch / {w!r}) AS BIGINT) AS bucket, count(*) AS n
  FROM log GROUP BY path, CAST(floor(ts_epoch / {w!r}) AS BIGINT)"""),
        ("peaks", "SELECT path, max(n) AS max_concurrency FROM buckets GROUP BY path"),
        ("loc", """
  SELECT log.path,
         CAST(sum(CASE WHEN log.client_node = m.primary_node THEN 1 ELSE 0 END) AS BIGINT)
           AS local_accesses,
         count(*) AS total_accesses
  FROM log LEFT JOIN manifest m ON log.path = m.path GROUP BY log.path"""),
        ("obs", view.get("end", "SELECT max(ts_epoch) AS observation_end FROM log")),
        ("filled", """
  SELECT m.path,
         COALESCE(s.access_freq, 0) AS access_freq,
         COALESCE(s.writes, 0) AS writes,
         COALESCE(s.reads, 0) AS reads,
         COALESCE(l.local_accesses, 0) AS local_accesses,
         COALESCE(l.total_accesses, 0) AS total_accesses,
         COALESCE(p.max_concurrency, 0) AS max_concurrency,
         COALESCE((SELECT observation_end FROM obs) - m.creation_epoch, 0.0) AS age_seconds
  FROM manifest m
  LEFT JOIN path_stats s ON m.path = s.path
  LEFT JOIN loc l ON m.path = l.path
  LEFT JOIN peaks p ON m.path = p.path"""),
        ("mu", """
  SELECT CASE WHEN avg(writes) IS NULL OR avg(writes) = 0 THEN 1.0
              ELSE avg(writes) END::DOUBLE AS mean_writes FROM filled"""),
        ("feats", """
  SELECT path, access_freq, age_seconds,
         CAST(writes AS DOUBLE) / (SELECT mean_writes FROM mu) AS write_ratio,
         CASE WHEN total_accesses > 0
              THEN CAST(local_accesses AS DOUBLE) / CAST(total_accesses AS DOUBLE)
              ELSE 1.0 END::DOUBLE AS locality,
         max_concurrency AS concurrency
  FROM filled"""),
        ("ranges", "SELECT " + ", ".join(
            f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in FEATURES) + " FROM feats"),
        ("normed", "SELECT feats.*, " + ", ".join(
            f"""CASE WHEN r.min_{c} IS NULL OR r.max_{c} IS NULL OR r.min_{c} = r.max_{c} THEN 0.0
         ELSE (CAST({c} AS DOUBLE) - CAST(r.min_{c} AS DOUBLE))
              / (CAST(r.max_{c} AS DOUBLE) - CAST(r.min_{c} AS DOUBLE)) END::DOUBLE AS {n}"""
            for c, n in zip(FEATURES, NORM_FEATURES)) + " FROM feats, ranges r"),
    ]


def feature_sql(view_name: str, final: str) -> str:
    view = VIEWS[view_name]
    return _with(view, *_feature_ctes(view)) + final


def feature_queries() -> dict:
    ce = "customer_events"
    return {
        "access_freq": feature_sql(ce, "SELECT path, access_freq FROM path_stats"),
        "rw_counts": feature_sql(ce, "SELECT path, writes, reads FROM path_stats"),
        "bucket_counts": feature_sql(ce, "SELECT path, bucket, n FROM buckets"),
        "peak_concurrency": feature_sql(ce, "SELECT path, max_concurrency FROM peaks"),
        "observation_end": feature_sql(ce, "SELECT observation_end FROM obs"),
        "locality": feature_sql(ce, """
SELECT path, local_accesses, total_accesses,
       CASE WHEN total_accesses > 0
            THEN CAST(local_accesses AS DOUBLE) / CAST(total_accesses AS DOUBLE)
            ELSE 1.0 END::DOUBLE AS locality
FROM filled"""),
        "locality_repeated": feature_sql(ce, """
SELECT o.path, coalesce(local_accesses, 0) AS local_accesses,
       coalesce(total_accesses, 0) AS total_accesses,
       CASE WHEN total_accesses > 0 THEN CAST(coalesce(local_accesses, 0) AS DOUBLE) / total_accesses
            ELSE 1.0 END::DOUBLE AS locality
FROM (SELECT CAST(o_custkey AS VARCHAR) AS path, 'dn' || (o_orderkey % 3 + 1) AS node FROM orders) o
LEFT JOIN (SELECT path, count(*) AS total_accesses FROM log GROUP BY path) t ON o.path = t.path
LEFT JOIN (SELECT path, client_node, count(*) AS local_accesses FROM log
           GROUP BY path, client_node) c ON o.path = c.path AND o.node = c.client_node"""),
        "feature_round_trip": feature_sql(ce, "SELECT * FROM normed"),
        "orphan_features": feature_sql("supplier_events", "SELECT * FROM normed"),
        "edge_features": feature_sql("edges", "SELECT * FROM normed"),
        "no_log_features": feature_sql("no_log", "SELECT * FROM normed"),
        "age_seconds": feature_sql(ce, """
SELECT path, (SELECT observation_end FROM obs) - creation_epoch AS age_seconds FROM manifest"""),
        "fill_missing": feature_sql(ce, "SELECT * FROM filled"),
        "write_ratio": feature_sql(ce, "SELECT path, write_ratio FROM feats"),
        "feature_table": feature_sql(ce, "SELECT * FROM feats"),
        "feature_ranges": feature_sql(ce, "SELECT * FROM ranges"),
        "minmax_norm": feature_sql(ce, "SELECT * FROM normed"),
        "minmax_norm_lineitem": feature_sql("part_lineitem", "SELECT * FROM normed"),
        "op_flags": _with(VIEWS[ce]) + """
SELECT log.path, log.ts_epoch, log.op, log.client_node, m.primary_node,
       CASE WHEN log.op = 'WRITE' THEN 1 ELSE 0 END AS is_write,
       CASE WHEN log.op = 'READ' THEN 1 ELSE 0 END AS is_read,
       CASE WHEN log.client_node = m.primary_node THEN 1 ELSE 0 END AS is_local
FROM log LEFT JOIN manifest m ON log.path = m.path""",
    }


def text_queries() -> dict:
    ce = _CE
    return {
        "scan_manifest": f"WITH t AS ({ce['manifest_text']}) SELECT * FROM t",
        "scan_access_log": f"WITH t AS ({ce['log_text']}) SELECT * FROM t",
        "log_export": f"WITH t AS ({ce['log_text']}) SELECT *, rank() OVER (ORDER BY ts_iso) "
                      "AS time_rank FROM t",
        "parse_ts": f"""WITH t AS ({ce['log_text']})
SELECT ts_iso, path, epoch(strptime(ts_iso, '%Y-%m-%dT%H:%M:%S.%gZ')) AS ts_epoch FROM t""",
        "parse_creation": f"""WITH t AS ({ce['manifest_text']})
SELECT path, creation_ts,
       CAST(floor(epoch(strptime(creation_ts, '%Y-%m-%dT%H:%M:%S.%fZ'))) AS DOUBLE) AS creation_epoch
FROM t""",
    }


def feature_sql_queries() -> dict:
    out = {}
    out.update(feature_queries())
    out.update(text_queries())
    return out


# ---- clustering and scoring chain -------------------------------------------------

K = 4
SEED = 42
LLOYD_ITERS = 3
_DEN = 2**52 + 1


def _u(seed: int, stream, id_expr: str) -> str:
    return (f"((('0x' || substr(md5('{seed}:{stream}:' || {id_expr}), 1, 13))::BIGINT)::DOUBLE"
            f" + CAST(1 AS DOUBLE)) / CAST({_DEN} AS DOUBLE)")


NORM_UNIT = f"CAST({2 ** 61} AS DOUBLE)"  # 62 bits below 2, for columns whose largest value is 1


def _mean(c: str, only: str = "", unit: str = NORM_UNIT) -> str:
    """Mean from whole units, summed in three parts of 21 bits: no order of addition can
    change it."""
    low, high = (f"CAST({2 ** b} AS DOUBLE)" for b in (21, 42))
    parts = (f"floor({c} * {unit} / {high})",
             f"floor({c} * {unit} / {low}) - floor({c} * {unit} / {high}) * {low}",
             f"floor({c} * {unit}) - floor({c} * {unit} / {low}) * {low}")
    a, b, rest = (f"CAST(sum(CAST({p} AS HUGEINT)) {only} AS DOUBLE)" for p in parts)
    return f"({a} * {high} + {b} * {low} + {rest}) / {unit} / count(*) {only}"


def _units_cte(src: str, cols) -> tuple:
    """One row with each column's units per 1: 2^62 over the power of two above its largest
    magnitude."""
    return ("units", "SELECT " + ", ".join(
        f"pow(CAST(2 AS DOUBLE), 61 - floor(log2(max(abs({c}))))) AS {c}" for c in cols) + f" FROM {src}")


def _sqdist(a: str, b: str, cols=NORM_FEATURES) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in cols)


def _seed_ctes(k: int = K, seed: int = SEED, src: str = "normed", cols=NORM_FEATURES,
               id_col: str = "path") -> list:
    sel = ", ".join(f"p.{c}" for c in cols)
    ctes = [("pts", f"SELECT {id_col} AS path, {', '.join(cols)} FROM {src}"),
            ("s0", f"""
  SELECT 0 AS seed_index, p.path, {sel} FROM pts p
  WHERE p.path = (SELECT arg_min(path, {_u(seed, 0, 'path')}) FROM pts)""")]
    for i in range(1, k):
        d = (f"{_sqdist('p', f's{i - 1}', cols)}" if i == 1 else
             f"least(d{i - 1}.d2, {_sqdist('p', f's{i - 1}', cols)})")
        join = f"pts p, s{i - 1}" if i == 1 else f"pts p JOIN d{i - 1} ON p.path = d{i - 1}.path, s{i - 1}"
        ctes.append((f"d{i}", f"SELECT p.path, {d} AS d2 FROM {join}"))
        ctes.append((f"s{i}", f"""
  SELECT {i} AS seed_index, p.path, {sel} FROM pts p
  WHERE p.path = (SELECT arg_min(path, -ln({_u(seed, i, 'path')}) / d2)
                  FROM d{i} WHERE d2 > 0)"""))
    ctes.append(("seeds", " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(k))))
    ds = [f"e{j}" for j in range(k)]
    dist = ", ".join(f"{_sqdist('p', f's{j}', cols)} AS e{j}" for j in range(k))
    joins = ", ".join(f"s{j}" for j in range(k))
    case = "CASE " + " ".join(
        f"WHEN {' AND '.join(f'{ds[j]} <= {ds[m]}' for m in range(j + 1, k))} THEN {j}"
        for j in range(k - 1)) + f" ELSE {k - 1} END"
    ctes.append(("dists", f"SELECT p.*, {dist} FROM pts p, {joins}"))
    ctes.append(("assigned", f"SELECT path, {', '.join(cols)}, {case} AS cluster FROM dists"))
    return ctes


def _median_ctes(k: int = K, cols=NORM_FEATURES) -> list:
    on = ", ".join(cols)
    piv = ", ".join(f"max(CASE WHEN feature = '{c}' THEN med END) AS {c}" for c in cols)
    return [
        ("long", f"UNPIVOT (SELECT cluster, {on} FROM assigned) ON {on} INTO NAME feature VALUE v"),
        ("ranked", """
  SELECT cluster, feature, v,
         row_number() OVER (PARTITION BY cluster, feature ORDER BY v) - 1 AS r,
         count(*) OVER (PARTITION BY cluster, feature) AS n
  FROM long"""),
        ("mids", """
  SELECT cluster, feature, (min(v) + max(v)) / 2 AS med FROM ranked
  WHERE r = (n - 1) // 2 OR r = n // 2 GROUP BY cluster, feature"""),
        ("ids", f"SELECT CAST(range AS INTEGER) AS cluster FROM range({k})"),
        ("medians", f"""
  SELECT ids.cluster, {', '.join(f'm.{c}' for c in cols)}
  FROM ids LEFT JOIN (SELECT cluster, {piv} FROM mids GROUP BY cluster) m
  ON ids.cluster = m.cluster"""),
    ]


def _lit(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _score_sql(rules, category: str, power: int = 2) -> str:
    terms = []
    raised = lambda x: "(" + " * ".join([x] * power) + ")"
    for p in rules.features:
        d = f"({p} - {_lit(rules.global_medians[p])})"
        w = _lit(rules.weights[category][p])
        direction = rules.directions[category][p]
        if category == rules.moderate:
            t = (f"CASE WHEN abs({d}) < {_lit(rules.moderate_band)} THEN "
                 f"{w} * {raised(f'(CAST(1 AS DOUBLE) - abs({d}))')} END")
        elif direction == 0:
            t = f"{w} * {raised(f'abs({d})')}"
        else:
            t = f"CASE WHEN sign({d}) = {int(direction)} THEN {w} * {raised(f'abs({d})')} END"
        terms.append(f"COALESCE({t}, CAST(0 AS DOUBLE))")
    return " + ".join(terms)


def _score_ctes(rules=DEFAULT_RULES, power: int = 2) -> list:
    parts = [f"SELECT cluster, '{c}' AS category, {_score_sql(rules, c, power)} AS score, "
             f"{rules.replication_factors[c]} AS rf, {i} AS ord FROM medians"
             for i, c in enumerate(rules.categories)]
    return [
        ("scores", " UNION ALL ".join(parts)),
        ("best", """
  SELECT cluster, category FROM (
    SELECT cluster, category,
           row_number() OVER (PARTITION BY cluster ORDER BY score DESC, rf DESC, ord) AS rk
    FROM scores) WHERE rk = 1"""),
    ]


def _centroid_ctes(cols=NORM_FEATURES) -> list:
    fid = " || '_' || ".join(f"printf('%.4f', u.{c})" for c in cols)
    return [
        ("upd", f"SELECT cluster, count(*) AS n, "
                + ", ".join(f"{_mean(c)} AS {c}" for c in cols)
                + " FROM assigned GROUP BY cluster"),
        ("centroids", f"""
  SELECT 'CENTROID_' || {fid} AS centroid_id, b.category, {', '.join(f'u.{c}' for c in cols)}
  FROM upd u LEFT JOIN best b ON u.cluster = b.cluster"""),
    ]


def _lloyd_ctes(iters: int, k: int = K, cols=NORM_FEATURES) -> list:
    """Iterations 2..iters of Lloyd after the assignment to the seeds
    (``assigned``): means of the previous labels, then nearest mean."""
    ctes, prev = [], "assigned"
    for t in range(2, iters + 1):
        ctes.append((f"means{t}", f"SELECT cluster, "
                     + ", ".join(f"{_mean(c)} AS {c}" for c in cols)
                     + f" FROM {prev} GROUP BY cluster"))
        for j in range(k):
            ctes.append((f"m{t}_{j}", f"SELECT * FROM means{t} WHERE cluster = {j}"))
        ds = [f"e{j}" for j in range(k)]
        dist = ", ".join(f"{_sqdist('p', f'm{t}_{j}', cols)} AS e{j}" for j in range(k))
        case = "CASE " + " ".join(
            f"WHEN {' AND '.join(f'{ds[j]} <= {ds[m]}' for m in range(j + 1, k))} THEN {j}"
            for j in range(k - 1)) + f" ELSE {k - 1} END"
        joins = ", ".join(f"m{t}_{j}" for j in range(k))
        ctes.append((f"dists{t}", f"SELECT p.*, {dist} FROM pts p, {joins}"))
        ctes.append((f"assigned{t}", f"SELECT path, {', '.join(cols)}, {case} AS cluster "
                     f"FROM dists{t}"))
        prev = f"assigned{t}"
    return ctes


def fit_sql(final: str, view_name: str = "customer_events", tol: float = 1e-4,
            raw: list | None = None) -> str:
    """Lloyd with its stopping rule as a recursive CTE. A step holds the k centres as one
    row; ``fitted`` are the labels of the last step, ``last`` the means of those labels.
    ``raw``: features as they are, in place of the normalised ones."""
    cols = raw or NORM_FEATURES
    units = {c: f"(SELECT {c} FROM units)" if raw else NORM_UNIT for c in cols}
    state = ", ".join(f"s{j}.{c} AS {c}_{j}" for j in range(K) for c in cols)
    names = [f"{c}_{j}" for j in range(K) for c in cols]

    def dist(j):
        return " + ".join(f"(p.{c} - g.{c}_{j}) * (p.{c} - g.{c}_{j})" for c in cols)

    case = "CASE " + " ".join(
        f"WHEN {' AND '.join(f'e{j} <= e{m}' for m in range(j + 1, K))} THEN {j}"
        for j in range(K - 1)) + f" ELSE {K - 1} END"
    labels = (f"SELECT q.*, {case} AS cluster FROM (SELECT p.path, {{keep}}, "
              + ", ".join(f"p.{c}" for c in cols) + ", "
              + ", ".join(f"{dist(j)} AS e{j}" for j in range(K)) + " FROM pts p, {g} g) q")
    step = labels.format(keep="g.it, g.shift, " + ", ".join(f"g.{n}" for n in names), g="steps")

    means = ", ".join(f"{_mean(c, f'FILTER (cluster = {j})', units[c])} AS n_{c}_{j}"
                      for j in range(K) for c in cols)
    shift = "sqrt(" + " + ".join(f"(n_{n} - {n}) * (n_{n} - {n})" for n in names) + ")"
    n_max = "(SELECT greatest(100, count(*) // 100) FROM pts)"
    rec = f"""
  SELECT 0 AS it, CAST('inf' AS DOUBLE) AS shift, {state}
  FROM {', '.join(f's{j}' for j in range(K))}
  UNION ALL
  SELECT it + 1, {shift}, {', '.join(f'n_{n}' for n in names)}
  FROM (SELECT any_value(it) AS it, {', '.join(f'any_value({n}) AS {n}' for n in names)}, {means}
        FROM ({step}) WHERE shift >= {_lit(tol)} AND it < {n_max} HAVING count(*) > 0)"""
    last = (f"SELECT cluster, count(*) AS n, "
            + ", ".join(f"{_mean(c, unit=units[c])} AS {c}" for c in cols)
            + " FROM assigned GROUP BY cluster")
    view = VIEWS[view_name]
    src = "normed"
    ctes = _feature_ctes(view)
    if raw:
        src = "raw_points"
        ctes += [(src, "SELECT path, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in raw)
                  + " FROM normed"), _units_cte(src, raw)]
    seeds = [c for c in _seed_ctes(src=src, cols=cols) if c[0] not in ("dists", "assigned")]
    ctes += seeds + [
        ("steps", rec),
        ("before", "SELECT * FROM steps WHERE it = (SELECT max(it) FROM steps) - 1"),
        ("assigned", labels.format(keep="0 AS it", g="before"))]
    if raw:
        return _with(view, *ctes, ("upd", last)).replace("WITH ", "WITH RECURSIVE ", 1) + final
    ctes += _median_ctes() + _score_ctes() + [c for c in _centroid_ctes() if c[0] != "upd"]
    ctes.insert(len(ctes) - 1, ("upd", last))
    return _with(view, *ctes).replace("WITH ", "WITH RECURSIVE ", 1) + final


def _far_sql(final: str) -> str:
    """Three seeds and a centre that no point is near: cluster 3 is empty."""
    ctes = _feature_ctes(_CE) + _seed_ctes(K - 1) + _median_ctes() + _score_ctes()
    ctes += [c for c in _centroid_ctes() if c[0] == "upd"]
    return _with(_CE, *ctes) + final


#: Features clustered as they are: seconds, and counts.
RAW = ["age_seconds", "access_freq"]


def fit_queries() -> dict:
    cols = ", ".join(NORM_FEATURES)
    return {
        "kmeans_fit_lineitem": fit_sql("SELECT path, cluster FROM assigned", "part_lineitem"),
        "kmeans_empty_cluster": _far_sql(
            f"SELECT cluster, n, {cols} FROM upd UNION ALL SELECT {K - 1}, 0, {cols} FROM pts WHERE "
            f"path = (SELECT arg_min(path, {_u(SEED, f'empty:1:{K - 1}', 'path')}) FROM pts)"),
        "kmeans_empty_clusters": _far_sql(
            f"SELECT cluster, n, {cols} FROM upd UNION ALL "
            + " UNION ALL ".join(
                f"SELECT {j}, 0, {cols} FROM pts WHERE path = "
                f"(SELECT arg_min(path, {_u(SEED, f'empty:1:{j}', 'path')}) FROM pts)"
                for j in range(K - 1, K + 2))),
        "kmeans_raw": fit_sql("SELECT path, cluster FROM assigned", raw=RAW),
        "kmeans_raw_centres": fit_sql("SELECT cluster, n, " + ", ".join(RAW) + " FROM upd", raw=RAW),
        "path_medians": _with(_PL) + """, long AS (
  UNPIVOT (SELECT path, ts_epoch, ts_epoch / 86400.0::DOUBLE AS day, 1.0::DOUBLE * hash_day AS hash_day
           FROM (SELECT *, CAST(ts_epoch / 86400 AS BIGINT) % 7 AS hash_day FROM log))
  ON ts_epoch, day, hash_day INTO NAME feature VALUE v),
ranked AS (
  SELECT path, feature, v, row_number() OVER (PARTITION BY path, feature ORDER BY v) - 1 AS r,
         count(*) OVER (PARTITION BY path, feature) AS n FROM long),
mids AS (SELECT path, feature, (min(v) + max(v)) / 2 AS med FROM ranked
         WHERE r = (n - 1) // 2 OR r = n // 2 GROUP BY path, feature)
SELECT path, max(CASE WHEN feature = 'ts_epoch' THEN med END) AS ts_epoch,
       max(CASE WHEN feature = 'day' THEN med END) AS day,
       max(CASE WHEN feature = 'hash_day' THEN med END) AS hash_day FROM mids GROUP BY path""",
        "empty_cluster_categories": _far_sql("SELECT * FROM best"),
        "point_count": feature_sql("customer_events", "SELECT count(*) AS n FROM normed"),
        "cluster_names": cluster_sql("SELECT path, 'C' || cluster AS name FROM assigned"),
        "scores_cubed": _with(_CE, *_feature_ctes(_CE), *_seed_ctes(), *_median_ctes(),
                              *_score_ctes(power=3)) + "SELECT cluster, category, score FROM scores",
        "kmeans_fit": fit_sql("SELECT path, cluster FROM assigned"),
        "file_categories": fit_sql("SELECT path, a.cluster, category FROM assigned a "
                                   "LEFT JOIN best b ON a.cluster = b.cluster"),
        "tiering_pipeline": fit_sql("SELECT * FROM centroids"),
    }


def cluster_sql(final: str, view_name: str = "customer_events") -> str:
    view = VIEWS[view_name]
    ctes = (_feature_ctes(view) + _seed_ctes() + _median_ctes() + _score_ctes()
            + _centroid_ctes() + _lloyd_ctes(LLOYD_ITERS))
    return _with(view, *ctes) + final


def cluster_queries() -> dict:
    shift = (f"SELECT round(sqrt(sum({_sqdist('m', 's')})), {ROUND}) AS shift FROM "
             f"(SELECT cluster, " + ", ".join(f"{_mean(c)} AS {c}" for c in NORM_FEATURES)
             + " FROM assigned GROUP BY cluster) m JOIN seeds s ON m.cluster = s.seed_index")
    on = ", ".join(NORM_FEATURES)
    glob = (f"""SELECT {', '.join(f"max(CASE WHEN feature = '{c}' THEN med END) AS {c}" for c in NORM_FEATURES)}
FROM (SELECT feature, (min(v) + max(v)) / 2 AS med FROM (
  SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r,
         count(*) OVER (PARTITION BY feature) AS n
  FROM (UNPIVOT (SELECT {on} FROM normed) ON {on} INTO NAME feature VALUE v))
WHERE r = (n - 1) // 2 OR r = n // 2 GROUP BY feature)""")
    return {
        "global_medians": cluster_sql(glob),
        "centroid_table_lineitem": cluster_sql("SELECT * FROM centroids", "part_lineitem"),
        "kmeanspp_init": cluster_sql("SELECT * FROM seeds"),
        "kmeanspp_d2": cluster_sql(f"SELECT path, d2 FROM d{K - 1}"),
        "kmeanspp_d2_total": cluster_sql(f"SELECT round(sum(d2), {ROUND}) AS d2_total FROM d{K - 1}"),
        "kmeans_assign": cluster_sql("SELECT path, cluster FROM assigned"),
        "kmeans_lloyd3": cluster_sql(f"SELECT path, cluster FROM assigned{LLOYD_ITERS}"),
        "kmeans_update": cluster_sql("SELECT * FROM upd"),
        "kmeans_shift": cluster_sql(shift),
        "cluster_rows": cluster_sql(
            "SELECT path, " + ", ".join(NORM_FEATURES) + " FROM assigned WHERE cluster = 0"),
        "cluster_medians": cluster_sql("SELECT * FROM medians"),
        "category_scores": cluster_sql("SELECT cluster, category, score FROM scores"),
        "classify_clusters": cluster_sql("SELECT * FROM best"),
        "centroid_table": cluster_sql("SELECT * FROM centroids"),
        "result_round_trip": cluster_sql("SELECT * FROM centroids"),
    }


def all_sql() -> dict:
    out = feature_sql_queries()
    out.update(cluster_queries())
    out.update(embedding_queries())
    out.update(fit_queries())
    return out


# ---- embeddings as points ----------------------------------------------------------

EMBED_K = 10


def _embed_cols():
    return [f"e{i:02d}" for i in range(64)]


def embedding_sql(final: str) -> str:
    cols = _embed_cols()
    src = ("SELECT CAST(vec_id AS VARCHAR) AS vec, "
           + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(cols))
           + " FROM embeddings")
    ctes = [("emb", src)] + _seed_ctes(EMBED_K, SEED, "emb", cols, "vec")
    ctes.append(_units_cte("emb", cols))
    ctes.append(("upd", "SELECT cluster, count(*) AS n, "
                 + ", ".join(f"{_mean(c, unit=f'(SELECT {c} FROM units)')} AS {c}" for c in cols)
                 + " FROM assigned GROUP BY cluster"))
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in ctes) + "\n" + final


def embedding_queries() -> dict:
    cols = ", ".join(_embed_cols())
    return {
        "embedding_kmeanspp_init": embedding_sql(f"SELECT seed_index, path AS vec, {cols} FROM seeds"),
        "embedding_kmeans_assign": embedding_sql("SELECT path AS vec, cluster FROM assigned"),
        "embedding_kmeans_update": embedding_sql("SELECT * FROM upd"),
    }
