"""DuckDB SQL with the rows of the catalogue's queries."""

from __future__ import annotations

_FRAME = """
frame AS (
  SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS rid,
         l_quantity AS qty, CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_extendedprice END AS price, l_discount AS disc, l_tax AS tax,
         l_returnflag || l_linestatus AS flagstat, l_orderkey % 3 AS ok3, l_partkey AS part, l_suppkey AS supp,
         CAST((l_quantity > 30 AND l_orderkey % 3 = 0) OR l_partkey % 17 = 3 AS INT) AS label
  FROM lineitem
), size AS (SELECT count(*) AS n FROM frame),
train AS (SELECT frame.* FROM frame, size WHERE rid < round(n * 0.75)),
valid AS (SELECT frame.* FROM frame, size WHERE rid >= round(n * 0.75)),
base AS (SELECT least(greatest(avg(label::double), 1e-6), 1 - 1e-6) AS p0, avg(label::double) AS prior FROM train)
"""


def _sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join([_FRAME, *parts]) + "\n" + body


def _knots(name: str, table: str, column: str, k: int = 16) -> str:
    """A table (i, knot) of the distinct values at the ranks of the knots."""
    return f"""
{name}_sorted AS (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) - 1 AS place, count(*) OVER () AS n FROM {table} WHERE {column} IS NOT NULL),
{name} AS (SELECT row_number() OVER (ORDER BY x) - 1 AS i, x AS knot FROM (
  SELECT DISTINCT x FROM {name}_sorted, range({k}) r(k) WHERE place = round((r.k / {k - 1}.0::double) * (n - 1))))"""


def _encoding(code: str) -> str:
    return f"""
enc_{code} AS (SELECT {code} AS code, (sum(label) + 20.0 * any_value(prior)) / (count(*) + 20.0) AS enc, count(*) AS cnt FROM train, base GROUP BY {code}),
full_{code} AS (SELECT rid, label, coalesce(enc, prior) AS enc, ln(1 + coalesce(cnt, 0)) AS cnt FROM train LEFT JOIN enc_{code} ON train.{code} = enc_{code}.code, base)"""


_NUMERIC = ("qty", "price", "disc", "tax")

QUANTILES = _sql(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, i::int AS i, knot FROM k_{c}" for c in _NUMERIC), *(_knots(f"k_{c}", "train", c) for c in _NUMERIC)
)
QUANTILES_HIGH = _sql(
    " UNION ALL ".join(f"SELECT '{c}_{v}' AS feature, i::int AS i, round(knot, 8) AS knot FROM k_{c}_{v}" for c in ("part", "supp") for v in ("enc", "cnt")),
    _encoding("part"), _encoding("supp"), *(_knots(f"k_{c}_{v}", f"full_{c}", v) for c in ("part", "supp") for v in ("enc", "cnt")),
)

_OOF = """
sums AS (SELECT part AS code, rid % 5 AS fold, sum(label) AS wy, count(*) AS n FROM train GROUP BY ALL),
rest AS (SELECT code, fold, sum(wy) OVER (PARTITION BY code) - wy AS wy, sum(n) OVER (PARTITION BY code) - n AS n FROM sums),
oof AS (SELECT rid, CASE WHEN r.n = 0 THEN prior ELSE (r.wy + 20.0 * prior) / (r.n + 20.0) END AS enc, ln(1 + r.n) AS cnt
        FROM train JOIN rest r ON part = code AND rid % 5 = fold, base)
"""


def _hat(rows: str, x: str, knots: str, offset: int = 0) -> str:
    """rid, idx, val of the piecewise-linear basis; ``rows`` has rid and x."""
    return f"""
span AS (SELECT min(knot) AS lo, max(knot) AS hi, count(*) AS n FROM {knots}),
steps AS (SELECT i, knot, lead(knot) OVER (ORDER BY i) AS nxt FROM {knots}),
hat AS (
  SELECT rid, n AS idx, 1.0::double AS val FROM {rows}, span WHERE {x} IS NULL
  UNION ALL SELECT rid, 0, 1.0 FROM {rows}, span WHERE {x} <= lo
  UNION ALL SELECT rid, n - 1, 1.0 FROM {rows}, span WHERE {x} >= hi AND n > 1
  UNION ALL SELECT rid, i, 1 - ({x} - knot) / (nxt - knot) FROM {rows}, steps, span WHERE {x} > lo AND {x} < hi AND {x} >= knot AND {x} < nxt
  UNION ALL SELECT rid, i + 1, ({x} - knot) / (nxt - knot) FROM {rows}, steps, span WHERE {x} > lo AND {x} < hi AND {x} >= knot AND {x} < nxt
)"""


def _basis() -> str:
    """The basis of validation rows over all features, each at its first slot."""
    parts, selects, at = [], [], "0"
    for c in _NUMERIC:
        parts += [_knots(f"k_{c}", "train", c), _named_hat(c, "valid", c, f"k_{c}")]
        selects.append(f"SELECT rid, ({at} + idx)::int AS idx, round(val, 6) AS val FROM hat_{c}")
        at += f" + (SELECT count(*) FROM k_{c}) + 1"
    for c in ("flagstat", "ok3"):
        parts.append(f"voc_{c} AS (SELECT {c} AS code, row_number() OVER (ORDER BY min(rid)) - 1 AS id, count(*) OVER () AS k FROM train WHERE {c} IS NOT NULL GROUP BY {c})")
        selects.append(f"SELECT rid, ({at} + CASE WHEN {c} IS NULL THEN k.k ELSE coalesce(id, k.k + 1) END)::int, 1.0 FROM valid LEFT JOIN voc_{c} ON {c} = code, (SELECT count(*) AS k FROM voc_{c}) k")
        at += f" + (SELECT count(*) FROM voc_{c}) + 2"
    for c in ("part", "supp"):
        parts += [_encoding(c), f"coded_{c} AS (SELECT rid, coalesce(enc, prior) AS enc, ln(1 + coalesce(cnt, 0)) AS cnt FROM valid LEFT JOIN enc_{c} ON valid.{c} = enc_{c}.code, base)"]
        for v in ("enc", "cnt"):
            parts += [_knots(f"k_{c}_{v}", f"full_{c}", v), _named_hat(f"{c}_{v}", f"coded_{c}", v, f"k_{c}_{v}")]
            selects.append(f"SELECT rid, ({at} + idx)::int, round(val, 6) FROM hat_{c}_{v}")
            at += f" + (SELECT count(*) FROM k_{c}_{v}) + 1"
    return _sql(" UNION ALL ".join(selects), *parts)


def _named_hat(name: str, rows: str, x: str, knots: str) -> str:
    return _hat(rows, x, knots).replace("span", f"span_{name}").replace("steps", f"steps_{name}").replace("hat AS", f"hat_{name} AS")


BASIS = _basis()


def _hist(column: str) -> str:
    return _knots("k", "train", column) + f""",
ends AS (SELECT min(knot) AS lo, max(knot) AS hi, list(knot ORDER BY i) AS ks FROM k),
cells AS (SELECT CASE WHEN {column} IS NULL THEN -1 ELSE len(list_filter(ks, lambda q: q <= {column})) END AS bin,
                 CASE WHEN {column} IS NULL THEN 0 ELSE least(greatest(({column} - lo) / (hi - lo), 0), 1) END AS z,
                 p0 - label AS g, p0 * (1 - p0) AS h FROM train, base, ends),
hist AS (SELECT bin, sum(g) AS g, sum(h) AS h, sum(g * z) AS gz, sum(h * z) AS hz, sum(h * z * z) AS hzz, count(*) AS n FROM cells GROUP BY bin)"""


def _score(side: str, aware: bool) -> str:
    g, h, gz, hz, hzz = (f"{side}_{c}" for c in ("g", "h", "gz", "hz", "hzz"))
    const = f"{g} * {g} / ({h} + 1)"
    if not aware:
        return f"({const})"
    det = f"(({h} + 1) * ({hzz} + 1) - {hz} * {hz})"
    return f"(CASE WHEN {det} <= 1e-12 THEN {const} ELSE (({hzz} + 1) * {g} * {g} - 2 * {hz} * {g} * {gz} + ({h} + 1) * {gz} * {gz}) / {det} END)"


def _candidates(column: str, aware: bool) -> str:
    sums = ("g", "h", "gz", "hz", "hzz", "n")
    return _hist(column) + f""",
bins AS (SELECT b AS bin, {', '.join(f'coalesce(hist.{c}, 0) AS {c}' for c in sums)} FROM range((SELECT count(*) FROM k) + 1) r(b) LEFT JOIN hist ON hist.bin = r.b),
gone AS (SELECT coalesce(sum(g), 0) AS m_g, coalesce(sum(h), 0) AS m_h, coalesce(sum(n), 0) AS m_n FROM hist WHERE bin = -1),
run AS (SELECT bin AS t, {', '.join(f'sum({c}) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS a_{c}, sum({c}) OVER () AS t_{c}' for c in sums)} FROM bins),
sides AS (SELECT t, dl, a_g + m_g * dl::int AS l_g, a_h + m_h * dl::int AS l_h, a_gz AS l_gz, a_hz AS l_hz, a_hzz AS l_hzz, a_n + m_n * dl::int AS l_n,
                 t_g - a_g + m_g * (NOT dl)::int AS r_g, t_h - a_h + m_h * (NOT dl)::int AS r_h, t_gz - a_gz AS r_gz, t_hz - a_hz AS r_hz, t_hzz - a_hzz AS r_hzz,
                 t_n - a_n + m_n * (NOT dl)::int AS r_n, t_g + m_g AS p_g, t_h + m_h AS p_h, t_gz AS p_gz, t_hz AS p_hz, t_hzz AS p_hzz
          FROM run, gone, (VALUES (true), (false)) d(dl) WHERE t < (SELECT count(*) FROM k)),
candidates AS (SELECT t, dl AS default_left, l_n AS n_left, r_n AS n_right, {_score('l', aware)} + {_score('r', aware)} - {_score('p', aware)} AS gain FROM sides WHERE l_n >= 50 AND r_n >= 50)"""


def _category_candidates(column: str) -> str:
    return f"""
codes AS (SELECT {column} AS code, row_number() OVER (ORDER BY min(rid)) - 1 AS id FROM train GROUP BY {column}),
per AS (SELECT id, sum(p0 - label) AS g, sum(p0 * (1 - p0)) AS h, count(*) AS n FROM train JOIN codes ON {column} = code, base GROUP BY id),
ord AS (SELECT *, row_number() OVER (ORDER BY g / greatest(h, 1), id) AS size FROM per),
run AS (SELECT size, string_agg(id::varchar, ',') OVER w AS left_set, sum(g) OVER w AS l_g, sum(h) OVER w AS l_h, sum(n) OVER w AS l_n,
               sum(g) OVER () AS t_g, sum(h) OVER () AS t_h, sum(n) OVER () AS t_n, count(*) OVER () AS k FROM ord WINDOW w AS (ORDER BY size ROWS UNBOUNDED PRECEDING)),
candidates AS (SELECT size, left_set, l_n AS n_left, t_n - l_n AS n_right,
                      l_g * l_g / (l_h + 1) + (t_g - l_g) * (t_g - l_g) / (t_h - l_h + 1) - t_g * t_g / (t_h + 1) AS gain
               FROM run WHERE size < k AND l_n >= 50 AND t_n - l_n >= 50)"""


_SCORED = "scored AS (SELECT rid, label, (qty / 50.0::double + part % 7) / 8.0::double AS score FROM frame)"
_GROUPS = """
g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY score),
c AS (SELECT *, sum(n) OVER w - n AS n_above, sum(pos) OVER w - pos AS pos_above FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""
_AP = "(SELECT sum(pos * (pos_above + pos)::double / (n_above + n)) / sum(pos) FROM c)"
_ROC = "(SELECT sum((n - pos)::double * (pos_above + pos / 2.0::double)) / (sum(pos)::double * sum(n - pos)) FROM c)"
_LOSS = "(SELECT avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END) FROM (SELECT label, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM scored))"


def _lift(share: float) -> str:
    return f"""(SELECT avg(label) FILTER (WHERE r <= k) / avg(label) FROM (SELECT label, row_number() OVER (ORDER BY score DESC, rid) AS r,
      least(greatest(round(count(*) OVER () * {share}), 1), count(*) OVER ()) AS k FROM scored))"""


def _steps(steps: int = 8) -> list[str]:
    """Newton steps for an intercept and two hats, a 3 x 3 system per leaf.

    They start at w0 (leaf, b, wu, wv, s0) and read x (leaf, y, u, v).
    """
    parts = []
    for i in range(steps):
        parts.append(
            f"""s{i} AS MATERIALIZED (SELECT leaf, sum(h) AS a, sum(h * u) AS d, sum(h * v) AS e, sum(h * u * u) + 1 AS f, sum(h * u * v) AS k, sum(h * v * v) + 1 AS m,
            sum(g) AS q, sum(g * u) + any_value(wu) AS r, sum(g * v) + any_value(wv) AS t, any_value(b) AS b, any_value(wu) AS wu, any_value(wv) AS wv, any_value(s0) AS s0
            FROM (SELECT leaf, u, v, p - y AS g, p * (1 - p) AS h, b, wu, wv, s0 FROM (SELECT x.leaf, y, u, v, b, wu, wv, s0, 1 / (1 + exp(-(s0 + b + wu * u + wv * v))) AS p FROM x JOIN w{i} w ON x.leaf = w.leaf)) GROUP BY leaf)"""
        )
        det = "(a * (f * m - k * k) - d * (d * m - k * e) + e * (d * k - f * e))"
        parts.append(
            f"""w{i + 1} AS MATERIALIZED (SELECT leaf, b - (q * (f * m - k * k) - d * (r * m - k * t) + e * (r * k - f * t)) / {det} AS b,
            wu - (a * (r * m - k * t) - q * (d * m - k * e) + e * (d * t - r * e)) / {det} AS wu,
            wv - (a * (f * t - r * k) - d * (d * t - r * e) + q * (d * k - f * e)) / {det} AS wv, s0 FROM s{i})"""
        )
    return parts


_HATS_OF_QTY = "1 - (qty - lo) / (hi - lo) AS u, (qty - lo) / (hi - lo) AS v"
_ENDS_OF_QTY = "(SELECT min(knot) AS lo, max(knot) AS hi FROM k)"

IRLS = _sql(
    "SELECT round(b, 6) AS bias, round(wu, 6) AS w_low, round(wv, 6) AS w_high FROM w8",
    _knots("k", "train", "qty", 2),
    f"x AS MATERIALIZED (SELECT 0 AS leaf, label AS y, {_HATS_OF_QTY} FROM train, {_ENDS_OF_QTY})",
    "w0 AS (SELECT 0 AS leaf, 0.0::double AS b, 0.0::double AS wu, 0.0::double AS wv, ln(p0 / (1 - p0)) AS s0 FROM base)",
    *_steps(),
)


def _split_side(place: str, best: str) -> str:
    """Whether a row goes left: bins up to t are left of threshold t."""
    return f"CASE {best}.f WHEN 2 THEN list_contains({best}.ids, {place}.b2) WHEN 1 THEN CASE WHEN {place}.b1 = -1 THEN {best}.dl ELSE {place}.b1 <= {best}.t END ELSE {place}.b0 <= {best}.t END"


def _best_splits(i: int) -> str:
    """best{i}: the best split of each node of rows{i}, over qty (0), price (1) and flagstat (2).

    Of equal gains (as 32-bit numbers) the first feature, then the first
    threshold wins, with missing rows left before right.
    """
    return f"""
h{i} AS MATERIALIZED (SELECT node, f, CASE f WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM rows{i}, range(3) r(f) GROUP BY ALL),
full{i} AS (SELECT a.node, a.f, a.bin, coalesce(h.g, 0) AS g, coalesce(h.h, 0) AS h, coalesce(h.n, 0) AS n
  FROM (SELECT nodes.node, sizes.f, r.b AS bin, sizes.k FROM (SELECT DISTINCT node FROM h{i}) nodes, sizes, range(64) r(b) WHERE r.b <= sizes.k) a
  LEFT JOIN h{i} h ON h.node = a.node AND h.f = a.f AND h.bin = a.bin),
gone{i} AS (SELECT node, f, g AS m_g, h AS m_h, n AS m_n FROM h{i} WHERE bin = -1 AND f < 2),
run{i} AS (SELECT full{i}.node, full{i}.f, bin AS t, coalesce(m_g, 0) AS m_g, coalesce(m_h, 0) AS m_h, coalesce(m_n, 0) AS m_n,
  sum(g) OVER w AS a_g, sum(h) OVER w AS a_h, sum(n) OVER w AS a_n, sum(g) OVER v AS t_g, sum(h) OVER v AS t_h, sum(n) OVER v AS t_n
  FROM full{i} LEFT JOIN gone{i} ON gone{i}.node = full{i}.node AND gone{i}.f = full{i}.f
  WINDOW w AS (PARTITION BY full{i}.node, full{i}.f ORDER BY bin ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY full{i}.node, full{i}.f)),
sides{i} AS (SELECT node, run{i}.f, t, dl, a_g + m_g * dl::int AS l_g, a_h + m_h * dl::int AS l_h, a_n + m_n * dl::int AS l_n, t_g + m_g AS p_g, t_h + m_h AS p_h, t_n + m_n AS p_n
  FROM run{i} JOIN sizes ON sizes.f = run{i}.f, (VALUES (true), (false)) d(dl) WHERE t < sizes.k),
ord{i} AS (SELECT node, bin, g, h, n, row_number() OVER (PARTITION BY node ORDER BY g / greatest(h, 1), bin) AS size FROM h{i} WHERE f = 2),
prefix{i} AS (SELECT node, size, list(bin) OVER w AS ids, sum(g) OVER w AS l_g, sum(h) OVER w AS l_h, sum(n) OVER w AS l_n, sum(g) OVER v AS p_g, sum(h) OVER v AS p_h, sum(n) OVER v AS p_n, count(*) OVER v AS k
  FROM ord{i} WINDOW w AS (PARTITION BY node ORDER BY size ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY node)),
all{i} AS (
  SELECT node, f, t, dl, CAST(NULL AS BIGINT[]) AS ids, l_g, l_h, l_n, p_g, p_h, p_n FROM sides{i}
  UNION ALL SELECT node, 2, size - 1, true, ids, l_g, l_h, l_n, p_g, p_h, p_n FROM prefix{i} WHERE size < k),
gains{i} AS (SELECT node, f, t, dl, ids, (l_g * l_g / (l_h + 1) + (p_g - l_g) * (p_g - l_g) / (p_h - l_h + 1) - p_g * p_g / (p_h + 1))::float AS gain FROM all{i} WHERE l_n >= 50 AND p_n - l_n >= 50),
best{i} AS MATERIALIZED (SELECT node, f, t, dl, ids, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, t, dl DESC) AS place FROM gains{i} WHERE gain > 0) WHERE place = 1)"""


_GROWN = [
    _knots("k_qty", "train", "qty"),
    _knots("k_price", "train", "price"),
    """
codes AS (SELECT flagstat AS code, row_number() OVER (ORDER BY min(rid)) - 1 AS id FROM train GROUP BY flagstat),
sizes AS (SELECT 0 AS f, (SELECT count(*) FROM k_qty) AS k UNION ALL SELECT 1, (SELECT count(*) FROM k_price)),
lists AS (SELECT (SELECT list(knot ORDER BY i) FROM k_qty) AS q, (SELECT list(knot ORDER BY i) FROM k_price) AS p),
binned AS MATERIALIZED (SELECT frame.*, len(list_filter(q, lambda x: x <= qty)) AS b0, CASE WHEN price IS NULL THEN -1 ELSE len(list_filter(p, lambda x: x <= price)) END AS b1, id AS b2 FROM frame JOIN codes ON flagstat = code, lists),
rows1 AS MATERIALIZED (SELECT b.rid, 0 AS node, b0, b1, b2, p0 - b.label AS g, p0 * (1 - p0) AS h FROM binned b, base, size WHERE b.rid < round(size.n * 0.75))""",
    _best_splits(1),
    f"""
rows2 AS MATERIALIZED (SELECT r.rid, CASE WHEN {_split_side('r', 'best1')} THEN 1 ELSE 2 END AS node, b0, b1, b2, g, h FROM rows1 r, best1)""",
    _best_splits(2),
    f"""
pick2 AS MATERIALIZED (SELECT * FROM best2 ORDER BY gain DESC, node DESC LIMIT 1),
rows3 AS MATERIALIZED (SELECT r.rid, CASE WHEN r.node <> pick2.node THEN r.node WHEN {_split_side('r', 'pick2')} THEN 3 ELSE 4 END AS node, b0, b1, b2, g, h FROM rows2 r, pick2)""",
    _best_splits(3),
    """
pick3 AS MATERIALIZED (SELECT * FROM best3 ORDER BY gain DESC, node DESC LIMIT 1),
leaf_ids AS (SELECT x AS node, CASE WHEN x > 4 THEN x - 3 WHEN pick3.node = 3 THEN CASE x WHEN 4 THEN 1 ELSE 0 END WHEN pick3.node = 4 THEN CASE x WHEN 3 THEN 1 ELSE 0 END ELSE 4 - x END AS leaf_id
  FROM (SELECT 3 - pick2.node AS x FROM pick2 UNION ALL SELECT * FROM (VALUES (3), (4), (5), (6)) v(x)) n, pick3 WHERE x <> pick3.node)""",
    f"""
routed AS (SELECT b.*, CASE WHEN {_split_side('b', 'best1')} THEN 1 ELSE 2 END AS n2 FROM binned b, best1),
routed3 AS (SELECT b.*, CASE WHEN n2 <> pick2.node THEN n2 WHEN {_split_side('b', 'pick2')} THEN 3 ELSE 4 END AS n3 FROM routed b, pick2),
placed AS MATERIALIZED (SELECT b.*, leaf_id FROM (SELECT b.*, CASE WHEN n3 <> pick3.node THEN n3 WHEN {_split_side('b', 'pick3')} THEN 5 ELSE 6 END AS n4 FROM routed3 b, pick3) b JOIN leaf_ids ON leaf_ids.node = n4)""",
]
_SPLIT_COLUMNS = "CASE f WHEN 0 THEN 'qty' WHEN 1 THEN 'price' ELSE 'flagstat' END AS feature, CASE f WHEN 0 THEN (SELECT knot FROM k_qty WHERE i = t) WHEN 1 THEN (SELECT knot FROM k_price WHERE i = t) END AS threshold, array_to_string(ids, ',') AS left_set, dl AS default_left"



def _states(n: int) -> str:
    """The generator's first n states from seed 42."""
    # fixed values: the shifts of the generator; a step is modulo 2 ** 64
    return f"""
WITH RECURSIVE states(i, x) AS (
  SELECT -1::BIGINT, 43::UBIGINT
  UNION ALL
  SELECT i + 1, xor(c, ((c::UHUGEINT * 131072) % 18446744073709551616)::UBIGINT) FROM (
    SELECT i, xor(b, b // 128) AS c FROM (SELECT i, xor(x, ((x::UHUGEINT * 8192) % 18446744073709551616)::UBIGINT) AS b FROM states WHERE i < {n - 1}))
)"""


DRAWS = _states(5_000) + "SELECT i, (x // 1099511627776)::double / 16777216 AS uniform FROM states WHERE i >= 0"


def _normal(u: str, first: int) -> str:
    """A normal number from six uniform ones of a list; all of 32 bits."""
    return f"(({' + '.join(f'{u}[{first + k}]' for k in range(6))} - 3::REAL) * {2**0.5!r}::REAL)"


# fixed values: the order of draws, and the coefficients of the log-odds
PROFILE = (
    _states(5_000 * 6 + 20_000 * 96)
    + f""",
uniforms AS MATERIALIZED (SELECT i, x, (x // 1099511627776)::REAL / 16777216::REAL AS u FROM states WHERE i >= 0),
risks AS (SELECT id, {_normal('u', 1)} * 0.9::REAL AS risk FROM (SELECT i // 6 AS id, list(u ORDER BY i) AS u FROM uniforms WHERE i < 30000 GROUP BY 1)),
drawn AS (SELECT (i - 30000) // 96 AS r, list(u ORDER BY i) AS u, list(x ORDER BY i) AS x FROM uniforms WHERE i >= 30000 GROUP BY 1),
scored AS (SELECT u, x[71] % 5000 AS id, -3.2::REAL + 0.8::REAL * ({_normal('u', 1)} * {_normal('u', 1)} - 1::REAL) + 1.1::REAL * {_normal('u', 7)} * (CASE WHEN x[61] % 8 % 2 = 0 THEN 1 ELSE -1 END)::REAL
  + 0.6::REAL * {_normal('u', 13)} + (CASE WHEN x[62] % 8 < 2 THEN 1.3 ELSE 0 END)::REAL + risk AS s FROM drawn JOIN risks ON risks.id = x[71] % 5000)
SELECT count(*) AS n, count_if(u[76] < (1::REAL / (1::REAL + exp(-s)::REAL)))::BIGINT AS pos, count_if(u[77] < 0.03::REAL)::BIGINT AS missing_num_0, count_if(u[87] < 0.02::REAL)::BIGINT AS missing_bcat_0, count(DISTINCT id) AS ids FROM scored"""
)

_TWO_LEAVES = [
    _candidates("qty", False).replace("range(16)", "range(2)").replace("/ 15.0::double", "/ 1.0::double"),
    "cut AS (SELECT knot AS thr FROM candidates JOIN k ON k.i = candidates.t WHERE gain > 0 ORDER BY gain::float DESC, t, default_left DESC LIMIT 1)",
    f"x AS MATERIALIZED (SELECT CASE WHEN qty < thr THEN 0 ELSE 1 END AS leaf, label AS y, {_HATS_OF_QTY} FROM train, cut, {_ENDS_OF_QTY})",
    "w0 AS (SELECT leaf, ln(p / (1 - p)) - ln(p0 / (1 - p0)) AS b, 0.0::double AS wu, 0.0::double AS wv, ln(p0 / (1 - p0)) AS s0 FROM (SELECT leaf, least(greatest(avg(y::double), 1e-6), 1 - 1e-6) AS p FROM x GROUP BY leaf), base)",
    *_steps(),
]


_STUMP = "best AS (SELECT 'qty' AS f, knot AS thr FROM candidates JOIN k ON k.i = candidates.t ORDER BY round(gain, 4) DESC, t, default_left DESC LIMIT 1)"


def oracle_sql() -> dict[str, str]:
    return {
        "temporal_split_counts": _sql("SELECT 'train' AS part, count(*) AS n, sum(label)::bigint AS pos FROM train UNION ALL SELECT 'valid', count(*), sum(label)::bigint FROM valid"),
        "class_weights": _sql("SELECT label, CASE WHEN label = 1 THEN 3.0::double ELSE 1.0::double END AS weight, count(*) AS n FROM train GROUP BY ALL"),
        "row_slice": _sql("SELECT rid, qty, price, flagstat, ok3, part, supp, label FROM frame WHERE rid >= 100 AND rid < 400"),
        "quantile_knots_numeric": QUANTILES,
        "quantile_knots_highcard": QUANTILES_HIGH,
        "weighted_rate": _sql("SELECT round(sum(CASE WHEN label = 1 THEN 3.0 ELSE 0 END)::double / sum(CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END)::double, 10) AS rate FROM train"),
        "base_score": _sql("SELECT round(p0, 10) AS p0, round(ln(p0 / (1 - p0)), 10) AS s0 FROM base"),
        "grad_hess": _sql("SELECT label, round(p0 - label, 10) AS g, round(p0 * (1 - p0), 10) AS h, count(*) AS n FROM train, base GROUP BY ALL"),
        "target_encoding": _sql("SELECT code, round(enc, 8) AS enc, cnt FROM enc_part", _encoding("part")),
        "target_encoding_oof": _sql("SELECT rid, round(enc, 8) AS enc, round(cnt, 8) AS cnt FROM oof", _OOF),
        "target_encoding_unique_ids": _sql("SELECT round(prior, 8) AS enc, 0.0::double AS cnt, count(*) AS n FROM train, base GROUP BY ALL"),
        "target_encode_unseen": _sql(
            "SELECT rid, round(coalesce(enc, prior), 8) AS enc, round(ln(1 + coalesce(cnt, 0)), 8) AS cnt FROM probe LEFT JOIN enc_part ON probe.p = code, base",
            _encoding("part"), "probe AS (SELECT rid, CASE WHEN rid % 7 = 0 THEN NULL WHEN rid % 11 = 0 THEN -part ELSE part END AS p FROM valid)",
        ),
        "vocab_first_seen": _sql("SELECT flagstat AS code, (row_number() OVER (ORDER BY min(rid)) - 1)::int AS id FROM train GROUP BY flagstat"),
        "bounded_codes_valid": _sql(
            "SELECT CASE WHEN c IS NULL THEN k ELSE coalesce(id, k + 1) END::int AS id, count(*) AS n FROM probe LEFT JOIN voc ON c = code, (SELECT count(*) AS k FROM voc) GROUP BY ALL",
            "voc AS (SELECT flagstat AS code, row_number() OVER (ORDER BY min(rid)) - 1 AS id FROM train GROUP BY flagstat)",
            "probe AS (SELECT CASE WHEN rid % 7 = 0 THEN NULL WHEN rid % 11 = 0 THEN '??' ELSE flagstat END AS c FROM valid)",
        ),
        "numeric_basis": _sql("SELECT rid, idx::int AS idx, round(val, 8) AS val FROM hat", _knots("k", "train", "price"), _hat("valid", "price", "k")),
        "onehot_basis": _sql(
            "SELECT rid, CASE WHEN c IS NULL THEN k ELSE coalesce(id, k + 1) END::int AS idx, 1.0::double AS val FROM probe LEFT JOIN voc ON c = code, (SELECT count(*) AS k FROM voc)",
            "voc AS (SELECT flagstat AS code, row_number() OVER (ORDER BY min(rid)) - 1 AS id FROM train GROUP BY flagstat)",
            "probe AS (SELECT rid, CASE WHEN rid % 7 = 0 THEN NULL WHEN rid % 11 = 0 THEN '??' ELSE flagstat END AS c FROM valid)",
        ),
        "basis_layout": _sql(
            """SELECT feature, (sum(size) OVER (ORDER BY i) - size)::int AS first_slot, size::int AS slots FROM (
            SELECT 0 AS i, 'qty' AS feature, (SELECT count(*) FROM k_qty) + 1 AS size UNION ALL SELECT 1, 'price', (SELECT count(*) FROM k_price) + 1
            UNION ALL SELECT 2, 'disc', (SELECT count(*) FROM k_disc) + 1 UNION ALL SELECT 3, 'tax', (SELECT count(*) FROM k_tax) + 1
            UNION ALL SELECT 4, 'flagstat', (SELECT count(DISTINCT flagstat) FROM train) + 2 UNION ALL SELECT 5, 'ok3', (SELECT count(DISTINCT ok3) FROM train) + 2
            UNION ALL SELECT 6, 'part', (SELECT count(*) FROM k_part_enc) + (SELECT count(*) FROM k_part_cnt) + 2
            UNION ALL SELECT 7, 'supp', (SELECT count(*) FROM k_supp_enc) + (SELECT count(*) FROM k_supp_cnt) + 2)""",
            *(_knots(f"k_{c}", "train", c) for c in _NUMERIC), _encoding("part"), _encoding("supp"),
            *(_knots(f"k_{c}_{v}", f"full_{c}", v) for c in ("part", "supp") for v in ("enc", "cnt")),
        ),
        "basis_expand_row": BASIS,
        "hist_numeric": _sql("SELECT bin::int AS bin, round(g, 4) AS g, round(h, 4) AS h, round(gz, 4) AS gz, round(hz, 4) AS hz, round(hzz, 4) AS hzz, n FROM hist", _hist("price")),
        "split_numeric_const": _sql("SELECT t::int AS t, default_left, n_left::bigint AS n_left, n_right::bigint AS n_right, round(gain, 4) AS gain FROM candidates", _candidates("price", False)),
        "split_numeric_leafaware": _sql("SELECT t::int AS t, default_left, n_left::bigint AS n_left, n_right::bigint AS n_right, round(gain, 4) AS gain FROM candidates", _candidates("price", True)),
        "split_categorical": _sql("SELECT size::int AS size, left_set, n_left::bigint AS n_left, n_right::bigint AS n_right, round(gain, 4) AS gain FROM candidates", _category_candidates("flagstat")),
        "parent_scores": _sql(
            f"SELECT round({_score('p', False)}, 4) AS constant_score, round({_score('p', True)}, 4) AS aware_score FROM (SELECT sum(g) AS p_g, sum(h) AS p_h, sum(gz) AS p_gz, sum(hz) AS p_hz, sum(hzz) AS p_hzz FROM hist)",
            _hist("price"),
        ),
        "best_split_root": _sql("SELECT knot AS threshold, default_left, round(gain, 4) AS gain FROM candidates JOIN k ON k.i = candidates.t ORDER BY round(gain, 4) DESC, t, default_left DESC LIMIT 1", _candidates("qty", False)),
        "stump_partition": _sql("SELECT qty < thr AS goes_left, count(*) AS n, sum(label)::bigint AS pos FROM train, best GROUP BY ALL", _candidates("qty", False), _STUMP),
        "stump_predict_constant_leaf": _sql(
            "SELECT valid.rid, round(p, 8) AS score FROM valid JOIN best ON true JOIN rates ON rates.l = (valid.qty < best.thr)", _candidates("qty", False), _STUMP,
            "rates AS (SELECT qty < thr AS l, least(greatest(avg(label::double), 1e-6), 1 - 1e-6) AS p FROM train, best GROUP BY 1)",
        ),
        "irls_one_feature": IRLS,
        "best_split_features": _sql(f"SELECT {_SPLIT_COLUMNS}, round(gain::double, 2) AS gain FROM best1", *_GROWN),
        "grown_nodes": _sql(
            f"""SELECT node::int AS node, {_SPLIT_COLUMNS}, (2 * step - 1)::int AS left_child, (2 * step)::int AS right_child, -1::int AS leaf_id
            FROM (SELECT 1 AS step, node, f, t, dl, ids FROM best1 UNION ALL SELECT 2, node, f, t, dl, ids FROM pick2 UNION ALL SELECT 3, node, f, t, dl, ids FROM pick3)
            UNION ALL SELECT node::int, NULL, NULL, NULL, NULL, -1::int, -1::int, leaf_id::int FROM leaf_ids""",
            *_GROWN,
        ),
        "grown_leaf_counts": _sql("SELECT leaf_id::int AS leaf_id, count(*) AS n, sum(label)::bigint AS pos FROM placed, size WHERE rid < round(n * 0.75) GROUP BY leaf_id", *_GROWN),
        "grown_predict": _sql(
            """SELECT rid, placed.leaf_id::int AS leaf_id, round(p, 8) AS score FROM placed JOIN rates ON rates.leaf_id = placed.leaf_id, size WHERE rid >= round(n * 0.75)""",
            *_GROWN, "rates AS (SELECT leaf_id, least(greatest(avg(label::double), 1e-6), 1 - 1e-6) AS p FROM placed, size WHERE rid < round(n * 0.75) GROUP BY leaf_id)",
        ),
        "linear_leaf_predict_two_knots": _sql(
            """SELECT rid, leaf::int AS leaf_id, round(1 / (1 + exp(-(s0 + b + wu * u + wv * v))), 6) AS score
            FROM (SELECT rid, CASE WHEN qty < thr THEN 0 ELSE 1 END AS own, least(greatest((qty - lo) / (hi - lo), 0), 1) AS v, 1 - least(greatest((qty - lo) / (hi - lo), 0), 1) AS u FROM valid, cut, (SELECT min(knot) AS lo, max(knot) AS hi FROM k))
            JOIN w8 ON leaf = own""",
            *_TWO_LEAVES,
        ),
        "scorer_paths_agree": _sql("SELECT count(*)::int AS n, true AS agree, true AS in_range FROM valid"),
        "generator_draws": DRAWS,
        "synthetic_profile": PROFILE,
        "order_desc": _sql("SELECT rid, row_number() OVER (ORDER BY score DESC, rid) - 1 AS place FROM scored", _SCORED),
        "log_loss": _sql(f"SELECT round({_LOSS}, 8) AS log_loss", _SCORED),
        "roc_auc": _sql(f"SELECT round({_ROC}, 8) AS roc_auc", _SCORED, _GROUPS),
        "pr_auc": _sql(f"SELECT round({_AP}, 8) AS pr_auc", _SCORED, _GROUPS),
        "lift_at_1pct": _sql(f"SELECT round({_lift(0.01)}, 8) AS lift", _SCORED),
        "lift_at_10pct": _sql(f"SELECT round({_lift(0.1)}, 8) AS lift", _SCORED),
        "reliability_bins": _sql(
            "SELECT b::int AS bin, coalesce(n, 0) AS n, round(coalesce(s, 0), 8) AS mean_score, round(coalesce(r, 0), 8) AS label_rate FROM range(10) t(b) LEFT JOIN (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS s, avg(label::double) AS r FROM scored GROUP BY 1) ON bin = b",
            _SCORED,
        ),
        "metrics_bundle": _sql(
            f"SELECT round({_AP}, 8) AS pr_auc, round({_ROC}, 8) AS roc_auc, round({_LOSS}, 8) AS log_loss, round({_lift(0.01)}, 8) AS lift_at_1, round({_lift(0.1)}, 8) AS lift_at_10", _SCORED, _GROUPS
        ),
    }
