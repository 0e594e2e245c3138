"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_RULES = " AND ".join(
    f"coalesce({r.numerator}::DOUBLE / nullif({r.denominator}, 0)::DOUBLE {op} {bound}::DOUBLE, true)"
    for r in RULES
    for op, bound in ((">=", r.low), ("<=", r.high))
    if bound is not None
)

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cover AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
          FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
             len(list_filter(words, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cover c ON c.doc_id = w.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_RULES} AS kept FROM f
"""

OP2 = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM it WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS k, least(10, len(w)) AS n FROM starts),
sizes AS (SELECT DISTINCT n FROM pat),
win AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM low, sizes WHERE len(w) >= n),
hits AS (SELECT win.doc_id, win.i, win.n, pat.item_id FROM win JOIN pat ON pat.n = win.n AND pat.k = array_to_string(win.w[win.i:win.i + win.n - 1], ' ')),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
np AS (SELECT doc_id, count(*)::BIGINT AS n_hit FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN np ON np.doc_id = low.doc_id LEFT JOIN ni ON ni.doc_id = low.doc_id
"""

#: Five hex digits are four digits of base 32.
OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS x, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::BIGINT) AS v FROM d),
a AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS digits)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda q: digits[(q // 32768) % 32 + 1] || digits[(q // 1024) % 32 + 1] || digits[(q // 32) % 32 + 1] || digits[q % 32 + 1]), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM b, a
"""

OP7 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS bits FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM per),
weighed AS (SELECT *, ([3.0, 1.0, 2.0][(r - 1) % 3 + 1])::DOUBLE AS w FROM ranked),
run AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
                  - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
               sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w FROM weighed),
lev AS (SELECT *, remains / left_w * w >= cap AS is_full, remains / left_w AS lvl FROM run),
aim AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (max(CASE WHEN NOT is_full THEN lvl END) OVER ()) * w END AS target FROM lev),
st AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS passes FROM aim),
bud AS (SELECT *, target - passes * source_size AS budget FROM st),
h AS (SELECT d.source, bits, sum(size)::DOUBLE AS words FROM d GROUP BY d.source, bits),
c AS (SELECT source, bits, words, sum(words) OVER (PARTITION BY source ORDER BY bits) AS upto FROM h),
edge AS (SELECT c.source, min(c.bits) AS bits, arg_min(words, c.bits) AS words, arg_min(upto, c.bits) AS upto
         FROM c JOIN bud b ON b.source IS NOT DISTINCT FROM c.source WHERE upto > budget GROUP BY c.source),
cut AS (SELECT b.*, coalesce(e.bits, -1) + CASE WHEN upto - budget < budget - (upto - words) THEN 1 ELSE 0 END AS threshold
        FROM bud b LEFT JOIN edge e ON e.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, c.source_size, c.target,
       (d.size * (c.passes + CASE WHEN d.bits < c.threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN cut c ON c.source IS NOT DISTINCT FROM d.source
"""

OP9 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
common AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN common c ON c.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP12 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id,
             list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i]))::BIGINT AS score
      FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: h is a conversation's CRC-32 modulo 4, computed bit by bit; nodes meet their ancestors along their smallest member's path.
OP13 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, md5(length(role)::VARCHAR || ':' || role || text) AS key,
             len(regexp_extract_all(text, '[^ 	-]+'))::BIGINT AS words FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM k),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, max(pos) AS n,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                             lambda v, b: list_reduce([xor(v, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                                      lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
      FROM p GROUP BY conv_id),
m AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT m.conv_id, p.pos AS depth, key, words FROM m JOIN p ON p.conv_id = m.base AND p.pos <= m.h
      UNION ALL SELECT m.conv_id, p.pos - m.h + m.taken, key, words FROM m JOIN p ON p.conv_id = m.conv_id AND p.pos > m.h),
f AS (SELECT conv_id, depth, words, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM m),
e AS (SELECT conv_id, max(depth) AS depth FROM f GROUP BY conv_id),
g AS (SELECT f.*, min(f.conv_id) OVER (PARTITION BY prefix) AS owner, f.depth = e.depth AS ends FROM f JOIN e ON e.conv_id = f.conv_id),
n AS (SELECT owner, depth, count(*)::BIGINT AS n_convs, max(words) AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM g GROUP BY owner, depth),
up AS (SELECT n.*, g.owner AS parent FROM n LEFT JOIN g ON g.conv_id = n.owner AND g.depth = n.depth - 1),
ch AS (SELECT parent AS owner, depth - 1 AS depth, count(*)::BIGINT AS n_children FROM up WHERE depth > 0 GROUP BY parent, depth),
x AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN ch ON ch.owner = up.owner AND ch.depth = up.depth),
s AS (SELECT g.owner, g.depth, count(*) FILTER (x.n_children = 0)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens
      FROM x JOIN g ON g.conv_id = x.owner AND g.depth <= x.depth GROUP BY g.owner, g.depth)
SELECT x.owner AS conv_id, x.depth::BIGINT AS depth, x.parent AS parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves, saved_tokens, ends_sha256
FROM x JOIN s ON s.owner = x.owner AND s.depth = x.depth
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op2_decontamination": OP2,
    "op5_warc": OP5,
    "op7_mixing": OP7,
    "op9_line_dedup": OP9,
    "op12_topk": OP12,
    "op13_prefix_trie": OP13,
}
