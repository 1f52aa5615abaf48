"""DuckDB SQL that gives the rows of the queries, where SQL can express them."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _xor(*terms: str) -> str:
    return terms[0] if len(terms) == 1 else f"xor({_xor(*terms[:-1])}, {terms[-1]})"


def _hilbert(bits: int = 4, axes: int = 4) -> str:
    """curve: the place on the Hilbert curve of each row of cells (x0, x1, ...)."""
    parts, last = [], "cells"
    x = [f"x{i}" for i in range(axes)]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(axes):
            swap = f"({_xor('x0', x[i])} & {q - 1})"
            new = {"x0": f"CASE WHEN {x[i]} & {q} <> 0 THEN {_xor('x0', str(q - 1))} ELSE {_xor('x0', swap)} END"}
            if i:
                new[x[i]] = f"CASE WHEN {x[i]} & {q} <> 0 THEN {x[i]} ELSE {_xor(x[i], swap)} END"
            parts.append(f"step{q}_{i} AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in new.items())}) FROM {last})")
            last = f"step{q}_{i}"
    parts.append(f"folded AS (SELECT * REPLACE ({', '.join(f'{_xor(*x[: i + 1])} AS {x[i]}' for i in range(axes))}) FROM {last})")
    turn = _xor(*(f"CASE WHEN {x[-1]} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END" for b in range(bits - 1, 0, -1)))
    parts.append(f"turned AS (SELECT *, {turn} AS turn FROM folded)")
    spread = [f"({_xor(x[i], 'turn')} >> {b}) & 1" for b in range(bits - 1, -1, -1) for i in range(axes)]
    parts.append("curve AS (SELECT *, " + " + ".join(f"(({v}) << {len(spread) - 1 - k})" for k, v in enumerate(spread)) + " AS curve FROM turned)")
    return ",\n".join(parts)


def _below(x: str) -> str:
    """How many of the 15 quantiles of a column of numbers lie below it; 0 for null."""
    return f"CAST(coalesce(len(list_filter(list_transform(range(1, 16), lambda k: s_{x}[CAST(ceil(k / 16.0::double * len(s_{x})) AS BIGINT)]), lambda c: c < {x})), 0) AS BIGINT)"


def _shared(x: str) -> str:
    """The seven bytes of a string, as digits, after those that all share."""
    return f"rpad(substr(hex(encode({x})), 2 * {x}_shared + 1, 14), 14, '0')"


def _shared_bytes(x: str) -> str:
    return f"(SELECT coalesce(list_max(list_filter(range(length(a) // 2 + 1), lambda k: substr(a, 1, 2 * k) = substr(b, 1, 2 * k) AND 2 * k <= length(b))), 0) FROM (SELECT hex(encode(min({x}))) AS a, hex(encode(max({x}))) AS b FROM documents)) AS {x}_shared"


# quantiles are exact, as the sketch is up to 5,000 rows a task; the checksum goes byte by byte through a table made from its polynomial
OP2 = f"""
WITH RECURSIVE steps(n, k, c) AS (
  SELECT n, 0, n::UBIGINT FROM range(256) r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS crc FROM steps WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, source, lang, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, k, substr(h, 2000 * k + 1, 2000) AS piece FROM (SELECT r, h, unnest(range((length(h) + 1999) // 2000)) AS k FROM docs)),
bytes AS (SELECT r, flatten(list(list_transform(range(length(piece) // 2), lambda i: CAST('0x' || substr(piece, 2 * i + 1, 2) AS UBIGINT)) ORDER BY k)) AS b FROM pieces GROUP BY r),
sums AS (SELECT r, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(crc[CAST(xor(c, x) % 256 AS BIGINT) + 1], c // 256)), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM bytes, crc),
ends AS (SELECT {_shared_bytes('source')}, {_shared_bytes('lang')}),
numbers AS (SELECT docs.r, doc_id, length(h) // 2 + 8 AS size, coalesce(text_crc32, 0) AS text_crc32, {_shared('source')} AS source, {_shared('lang')} AS lang FROM docs LEFT JOIN sums ON sums.r = docs.r, ends),
sorted AS (SELECT {', '.join(f"list({x} ORDER BY {x}) FILTER (WHERE {x} IS NOT NULL) AS s_{x}" for x in ('source', 'lang', 'size', 'doc_id'))} FROM numbers),
cells AS (SELECT doc_id, size, text_crc32, {', '.join(f"{_below(x)} AS x{i}" for i, x in enumerate(('source', 'lang', 'size', 'doc_id')))} FROM numbers, sorted),
{_hilbert()},
placed AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST, size) - 1 AS place, count(*) OVER () AS n FROM curve)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 24 // n AS INT) AS shard, place - ((place * 24 // n) * n + 23) // 24 AS slot, CAST(NULL AS INT) AS grown_shard, curve FROM placed
"""

# bytes as hexadecimal digits; texts go by pieces, as cutting a string reads it from its start
OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, k, substr(h, 2000 * k + 1, 2198) AS piece FROM (SELECT doc_id, h, unnest(range((length(h) + 1999) // 2000)) AS k FROM d)),
strings AS (SELECT doc_id, 1000 * k + j AS i, substr(piece, 2 * j + 1, 200) AS s FROM (SELECT *, unnest(range(least(1000, length(piece) // 2 - 99))) AS j FROM pieces WHERE length(piece) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS place FROM strings) WHERE place > 1),
marked AS (SELECT doc_id, i, CAST(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS INT) AS new FROM later),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT doc_id, i, sum(coalesce(new, 0)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS b FROM runs
  UNION ALL SELECT d.doc_id, coalesce(max(hi), 0), any_value(length(h) // 2) FROM d LEFT JOIN runs ON d.doc_id = runs.doc_id GROUP BY d.doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, (length(h) - length(k)) // 2 AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""

OP6 = rf"""
WITH lines AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), bad AS (
  SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.doc_id, l.i, l.line, (b.k IS NOT NULL AND l.doc_id <> b.keep) AS gone FROM lines l LEFT JOIN bad b ON l.k = b.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i + 1, i + least(len(w), 13)), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + least(len(w), 4)), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, b FROM reach r JOIN ways ON r.other = a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_hilbert_shards": OP2, "op4_suffix_dedup": OP4, "op6_line_dedup": OP6, "op7_exact_dedup": OP7, "op8_decontaminate": OP8, "op10_super_minhash": OP10}
