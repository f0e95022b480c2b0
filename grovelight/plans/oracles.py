"""The catalogue's queries as SQL over the same tables."""

from __future__ import annotations

from ..operators.binning import normal_quantiles


def draw(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"


L_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
L_ROWS = f"""rows AS MATERIALIZED (SELECT '0' AS split, (l_orderkey % 3)::INTEGER AS client,
  row_number() OVER (PARTITION BY l_orderkey % 3 ORDER BY {draw('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber')}, {L_COLUMNS}) - 1 AS row_id,
  [l_quantity, l_extendedprice, l_discount, l_tax] AS f,
  CASE l_returnflag WHEN 'A' THEN 0.0::DOUBLE WHEN 'N' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS y FROM lineitem)"""


def e_rows(split: str = "0", where: str = "true") -> str:
    return f"""rows AS MATERIALIZED (SELECT '{split}' AS split, (vec_id % 3)::INTEGER AS client,
  row_number() OVER (PARTITION BY vec_id % 3 ORDER BY {draw('vec_id')}, vec_id) - 1 AS row_id,
  list_transform(embedding, lambda x: x::DOUBLE) AS f, label::DOUBLE AS y FROM embeddings WHERE {where})"""


E_ROWS = e_rows()
P_ROWS = f"""rows AS MATERIALIZED (SELECT '0' AS split, (p_partkey % 3)::INTEGER AS client,
  row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY {draw('p_partkey')}, p_partkey) - 1 AS row_id,
  [p_size::DOUBLE, (p_partkey % 50)::DOUBLE] AS f, round(p_retailprice) AS y FROM part)"""


def edges(p: int, n_bins: int) -> str:
    return f"""mm AS (SELECT i::INTEGER AS feature, min(f[i + 1]) AS mn, max(f[i + 1]) AS mx FROM rows, range({p}) t(i) GROUP BY i),
edges AS (SELECT feature, list_transform(range({n_bins}), lambda i: i * ((mx - mn) / {n_bins}) + mn) AS e FROM mm)"""


def binned(p: int, n_bins: int) -> str:
    return f"{edges(p, n_bins)},\n{bins_of(p, 'rows', 'binned')}"


def bins_of(p: int, rows: str, name: str) -> str:
    """CTE ``name``: the bins of ``rows`` by the edges of the training rows."""
    bins = ", ".join(f"len(list_filter(es[{i + 1}], lambda v: v <= f[{i + 1}]))::INTEGER - 1" for i in range(p))
    return f"{name} AS MATERIALIZED (SELECT client, row_id, y, [{bins}] AS bins FROM {rows} CROSS JOIN (SELECT list(e ORDER BY feature) AS es FROM edges))"


def moments(p: int) -> str:
    return f"""part AS (SELECT client, i::INTEGER AS feature, count(*) AS n, sum(f[i + 1] * f[i + 1]) AS sxx, sum(f[i + 1]) AS sx FROM rows, range({p}) t(i) GROUP BY client, i),
stats AS (SELECT feature, sum(sx) / sum(n) AS mean, sqrt(greatest(sum(sxx) / sum(n) - (sum(sx) / sum(n)) * (sum(sx) / sum(n)), 0)) AS sd FROM part GROUP BY feature)"""


def quantile_list(n_bins: int) -> str:
    return "[" + ", ".join("'infinity'::DOUBLE" if q == float("inf") else f"{q!r}::DOUBLE" for q in normal_quantiles(n_bins)) + "]"


def features(n_trees: int, p: int, k: int, seed: int) -> str:
    return f"""tf AS (SELECT tree, pos, feature FROM (SELECT t.i::INTEGER AS tree, g.i::INTEGER AS feature,
  (row_number() OVER (PARTITION BY t.i ORDER BY {draw(str(seed), "'f'", 't.i', 'g.i')}, g.i) - 1)::INTEGER AS pos FROM range({n_trees}) t(i), range({p}) g(i)) WHERE pos < {k})"""


def bootstrap(n_trees: int, seed: int, m: str = "n", split: str = "0") -> str:
    return f"""sizes AS (SELECT client, count(*) AS n FROM rows GROUP BY client),
sample AS MATERIALIZED (SELECT client, tree, row_id, count(*) AS mult FROM (SELECT client, t.i::INTEGER AS tree,
  {draw(str(seed), "'b'", f"'{split}'", 'client', 't.i', 'd.i')} % n AS row_id FROM sizes, range({n_trees}) t(i), LATERAL (SELECT unnest(range({m})) AS i) d) GROUP BY client, tree, row_id)"""


def _plus(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def score_sql(k: int | None, weights: list[float | str] | None = None, lengths: str = "lengths") -> str:
    """Local score from columns l0.. and t0..; k classes, or None for (n, s, ss) in regression. A weight may be an expression."""
    if k is None:
        m = lambda n, s, ss: f"({ss} / {n} - ({s} / {n}) * ({s} / {n}))"
        return f"""CASE WHEN l0 = 0 OR t0 - l0 = 0 THEN {m('t0', 't1', 't2')}
          ELSE (l0 * {m('l0', 'l1', 'l2')} + (t0 - l0) * {m('(t0 - l0)', '(t1 - l1)', '(t2 - l2)')}) / t0 END"""
    nl, nr = _plus(f"l{c}" for c in range(k)), _plus(f"(t{c} - l{c})" for c in range(k))
    d = lambda x: f"CAST({x} AS DOUBLE)"
    times = lambda c: f" * {weights[c] if isinstance(weights[c], str) else f'{weights[c]!r}::DOUBLE'}" if weights else ""
    sq = lambda count, by, c: f"({d(count)}{times(c)} / {by}) * ({d(count)}{times(c)} / {by})"
    by = lambda counts, n: n if lengths == "lengths" else _plus(d(x) + times(c) for c, x in enumerate(counts))
    side = lambda counts, n: f"{d(n)} / ({nl} + {nr}) * (1.0 - {_plus(sq(x, by(counts, n), c) for c, x in enumerate(counts))})"
    return f"CASE WHEN {nl} = 0 OR {nr} = 0 THEN 1.0::DOUBLE ELSE {side([f'l{c}' for c in range(k)], nl)} + {side([f'(t{c} - l{c})' for c in range(k)], nr)} END"


def level(d: int, n_bins: int, k: int | None, min_split: int, min_leaf: int, weights=None, lengths: str = "lengths") -> str:
    """CTEs of one level over a{d}(client, tree, node, mult, bins, y): h, s, g, b, c and n (decisions)."""
    terms = [f"CASE WHEN y = {c} THEN mult ELSE 0 END" for c in range(k)] if k else ["mult::DOUBLE", "mult * y", "mult * y * y"]
    kind = "BIGINT" if k else "DOUBLE"
    w = len(terms)
    lows = ", ".join(f"sum(CASE WHEN bins[feature + 1] <= thr THEN {t} ELSE 0 END)::{kind} AS l{i}" for i, t in enumerate(terms))
    tots = ", ".join(f"sum({t})::{kind} AS t{i}" for i, t in enumerate(terms))
    pure = (lambda p: f"{_plus(f'({x} > 0)::INTEGER' for x in p)} <= 1") if k else (lambda p: f"({p[0]} = 0 OR {p[0]} * {p[2]} - {p[1]} * {p[1]} <= 1e-9 * {p[0]} * {p[2]})")
    cols = {s: [(f"l{i}", f"(t{i} - l{i})", f"t{i}")["lrt".index(s)] for i in range(w)] for s in "lrt"}
    count = (lambda s: f"sum({_plus(cols[s])})::BIGINT") if k else (lambda s: f"sum({cols[s][0]})::BIGINT")

    def value(s: str) -> str:
        if k is None:
            return f"list_reduce(list({cols[s][1]} / {cols[s][0]} ORDER BY client) FILTER (WHERE {cols[s][0]} > 0), lambda a, b: a + b) / count(*) FILTER (WHERE {cols[s][0]} > 0)"
        sums = [f"sum({x})" for x in cols[s]]
        return "CASE " + " ".join(f"WHEN {sums[c]} = greatest({', '.join(sums)}) THEN {float(c)}::DOUBLE" for c in range(k)) + " END"

    return f"""h{d} AS MATERIALIZED (SELECT client, a.tree, node, pos, feature, thr::INTEGER AS thr, {lows}, {tots}
  FROM a{d} a JOIN tf ON a.tree = tf.tree, range({n_bins}) r(thr) GROUP BY client, a.tree, node, pos, feature, thr),
s{d} AS (SELECT client, tree, node, pos, feature, thr, CASE WHEN node <> 1 AND {pure(cols['t'])} THEN 0.0::DOUBLE ELSE {score_sql(k, weights, lengths)} END AS score FROM h{d}),
g{d} AS MATERIALIZED (SELECT tree, node, pos, feature, thr, list_reduce(list(score ORDER BY client), lambda a, b: a + b) AS score FROM s{d} GROUP BY tree, node, pos, feature, thr),
b{d} AS MATERIALIZED (SELECT * FROM g{d} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY score, pos, thr) = 1),
c{d} AS (SELECT h.tree, h.node, h.feature, h.thr, b.score, {', '.join(f"{count(s)} AS {s}n, count(*) FILTER (WHERE NOT {pure(cols[s])}) AS {s}i, {value(s)} AS {s}v" for s in 'lrt')}
  FROM h{d} h JOIN b{d} b ON h.tree = b.tree AND h.node = b.node AND h.pos = b.pos AND h.thr = b.thr GROUP BY h.tree, h.node, h.feature, h.thr, b.score),
n{d} AS MATERIALIZED (SELECT *, least(ln, rn) < {min_leaf} AS leaf, ln < {min_split} OR li = 0 AS lleaf, rn < {min_split} OR ri = 0 AS rleaf FROM c{d})"""


def forest(base: str, n_bins: int, p: int, n_trees: int, k_features: int, seed: int, levels: int, k: int | None, min_split: int = 2, min_leaf: int = 1, weights=None, m: str = "n", split: str = "0") -> str:
    """CTEs up to ``nodes`` (tree, node_id, depth, feature, thr, score, is_leaf, value) of ``levels`` split levels."""
    parts = [base, binned(p, n_bins), features(n_trees, p, k_features, seed), bootstrap(n_trees, seed, m, split), "a1 AS MATERIALIZED (SELECT s.client, s.tree, 1::BIGINT AS node, s.mult, b.bins, b.y FROM sample s JOIN binned b ON s.client = b.client AND s.row_id = b.row_id)"]
    rows = []
    for d in range(1, levels + 1):
        parts.append(level(d, n_bins, k, min_split, min_leaf, weights))
        rows.append(f"SELECT tree, node AS node_id, {d - 1} AS depth, CASE WHEN NOT leaf THEN feature END AS feature, CASE WHEN NOT leaf THEN thr END AS thr, CASE WHEN NOT leaf THEN score END AS score, leaf AS is_leaf, CASE WHEN leaf THEN tv END AS value FROM n{d}")
        for s, bit in (("l", 0), ("r", 1)):
            rows.append(f"SELECT tree, node * 2 + {bit}, {d}, NULL, NULL, NULL, true, {s}v FROM n{d} WHERE NOT leaf" + ("" if d == levels else f" AND {s}leaf"))
        if d < levels:
            parts.append(f"""a{d + 1} AS MATERIALIZED (SELECT a.client, a.tree, a.node * 2 + (bins[feature + 1] > thr)::BIGINT AS node, mult, bins, y FROM a{d} a JOIN n{d} n ON a.tree = n.tree AND a.node = n.node
  WHERE NOT leaf AND CASE WHEN bins[feature + 1] > thr THEN NOT rleaf ELSE NOT lleaf END)""")
    parts.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")")
    return ",\n".join(parts)


def predictions(levels: int, rows: str = "binned") -> str:
    """CTE ``preds`` (client, row_id, tree, pred) of all rows that are binned in ``rows``."""
    parts = [f"w0 AS (SELECT client, row_id, bins, y, tree, 1::BIGINT AS node FROM {rows}, (SELECT DISTINCT tree FROM nodes))"]
    for i in range(1, levels + 1):
        parts.append(f"w{i} AS (SELECT w.client, w.row_id, w.bins, w.y, w.tree, CASE WHEN n.is_leaf THEN w.node ELSE w.node * 2 + (bins[feature + 1] > thr)::BIGINT END AS node FROM w{i - 1} w JOIN nodes n ON w.tree = n.tree AND w.node = n.node_id)")
    parts.append(f"preds AS MATERIALIZED (SELECT w.client, w.row_id, w.tree, w.y, n.value AS pred FROM w{levels} w JOIN nodes n ON w.tree = n.tree AND w.node = n.node_id)")
    return ",\n".join(parts)


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
