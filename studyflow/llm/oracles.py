"""DuckDB SQL for contract queries whose operators work by hashes and indexes: the same results, by plain joins."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p, w FROM b WHERE len(w) > 0),
bk AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS key FROM bw),
dw AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, (SELECT DISTINCT k FROM bk) WHERE len(w) >= k),
h AS (SELECT dw.r, dw.p, dw.k, bk.item FROM dw JOIN bk ON bk.k = dw.k AND bk.key = array_to_string(dw.w[dw.p:dw.p + dw.k - 1], ' ')),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN i ON i.r = d.r
"""

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
g AS (SELECT r, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] AS key FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
m AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, key) AS c FROM g) WHERE c > 1),
v AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM m) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
  coalesce(v.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[a-z]')) AS n_lower FROM d LEFT JOIN v ON v.r = d.r LEFT JOIN l ON l.r = d.r),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 4 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR n_upper > n_lower) AS kept FROM j
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + least(4, len(w)) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b),
m AS (SELECT t.a AS r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.b GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n ON n.r = d.r JOIN m ON m.r = d.r
"""

# The order, the sums before each record, and the CRC of the bytes by its table of 256 entries.
OP10_SQL = """
WITH tb AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size FROM documents),
o AS (SELECT *, sum(size) OVER w - size AS start, (SELECT sum(size) FROM d) AS total FROM d WINDOW w AS (ORDER BY md5(text), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, least((start * 40) // total, 39)::INT AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start, md5(text), doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM p, tb
"""
