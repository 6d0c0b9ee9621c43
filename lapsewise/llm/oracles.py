"""SQL twins of the registered queries, for DuckDB. They compare all rows with all others
and are meant for small tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# CRC-32 of the decimal text of a number: the table of its bytes by rule, then byte by byte.
CRC = """
crc_steps AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) AS r(i))"""


def crc(number: str) -> str:
    """For a query that reads ``crc_steps`` too."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(4294967295, list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"


# From ``links`` (a < b) the smallest node that each node reaches.
REACHED = """
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a AS node, b AS other FROM sides UNION SELECT r.node, e.b FROM reached r JOIN sides e ON e.a = r.other),
parts AS (SELECT node, min(least(node, other)) AS component FROM reached GROUP BY node)"""

# All runs of 50 bytes as text of 100 hexadecimal digits.
ORACLES["op2_suffix_repeats"] = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
grams AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS p FROM bytes)),
firsts AS (SELECT s, min(doc_id) AS first FROM grams GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM grams JOIN firsts USING (s) WHERE first < doc_id),
marked AS (SELECT doc_id, p, count(*) FILTER (before IS NULL OR p > before + 50) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM hits),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM marked GROUP BY doc_id, span),
gone AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
pieces AS (
  SELECT doc_id, a, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS kept
  FROM spans JOIN bytes USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL
  SELECT doc_id, 1000000000, substr(h, 2 * e + 1) FROM bytes JOIN (SELECT doc_id, max(b) AS e FROM spans GROUP BY doc_id) USING (doc_id)),
left_over AS (SELECT doc_id, string_agg(kept, '' ORDER BY a) AS kept FROM pieces GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM bytes LEFT JOIN gone USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

ORACLES["op3_ngram_jaccard"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
{REACHED.strip()}
SELECT doc_id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM sets LEFT JOIN parts ON node = doc_id"""

ORACLES["op8_epsilon_grid"] = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.93::DOUBLE),
{REACHED.strip()},
degrees AS (SELECT a AS node, count(*) AS n FROM sides GROUP BY a)
SELECT vec_id, coalesce(d.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN parts p ON p.node = vec_id LEFT JOIN degrees d ON d.node = vec_id"""

# Every lag of every text, stretches of equal words as islands.
ORACLES["op12_periodic_runs"] = f"""
WITH {CRC.strip()},
plain AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc('doc_id')} AS h FROM documents, crc_steps),
planted AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM plain),
words AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w
  FROM planted),
lags AS (SELECT doc_id, w, n, unnest(range(1, n // 4 + 1)) AS q FROM words),
places AS (SELECT doc_id, q, unnest(list_filter(range(1, n - q + 1), lambda i: w[i] = w[i + q])) - 1 AS i FROM lags),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM places),
stretches AS (SELECT doc_id, q, min(i) AS a, count(*) + q AS length FROM islands GROUP BY doc_id, q, isle),
runs AS (
  SELECT doc_id, a AS start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, a, length),
found AS (
  SELECT doc_id, count(*) AS n_runs, max({{'l': length, 's': -start, 'p': -period}}) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id),
said AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM words),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM said ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.l AS length, -best.p AS period,
  1000 * best.l // -best.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM words LEFT JOIN found USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

ORACLES["op13_prefix_trie"] = f"""
WITH {CRC.strip()},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {crc('c')} % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM turns), crc_steps),
rebuilt AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d FROM (
    SELECT c, 0 AS own, pos, role, text FROM convs JOIN turns ON conv_id = c - c % 100 AND pos < h
    UNION ALL SELECT c, 1, pos, role, text FROM convs JOIN turns ON conv_id = c AND pos >= h)),
members AS (
  SELECT c, d, list({{'role': role, 'text': text}}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, length(text) AS n
  FROM rebuilt
  UNION ALL SELECT c, 0, [], 0 FROM convs),
ends AS (SELECT c, max(d) AS last FROM members GROUP BY c),
nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last = d), '') AS ids
  FROM members JOIN ends USING (c) GROUP BY d, path),
children AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
below AS (
  SELECT up AS d, path[1:up] AS path, CAST(sum(saved) AS BIGINT) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT nodes.path, saved, children.n IS NULL AS leaf, unnest(range(nodes.d + 1)) AS up FROM nodes LEFT JOIN children ON children.d = nodes.d AND children.path = nodes.path)
  GROUP BY 1, 2)
SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0) AS n_children,
  below.leaves AS n_leaves, below.saved AS saved_tokens, sha256(nodes.ids) AS ends_sha256
FROM nodes LEFT JOIN children ON children.d = nodes.d AND children.path = nodes.path
  JOIN below ON below.d = nodes.d AND below.path = nodes.path
  LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.path = nodes.path[1:nodes.d - 1]"""
