"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .line_runs import DIGEST_SQL

_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLD)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(len(ws) - 3), lambda i: array_to_string(ws[i + 1 : i + 4], ' ')))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
p AS (SELECT doc_id, unnest(sh) AS h FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM p a JOIN p b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

REPEATED_BYTES = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, (length(x) // 2)::BIGINT AS n FROM h),
w AS (SELECT doc_id, s, substr(x, (2 * s + 1)::BIGINT, 200) AS win FROM (SELECT doc_id, x, unnest(range(greatest(n - 99, 0))) AS s FROM b)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1 AS later FROM w),
y AS (SELECT b.doc_id, b.n, q.k, substr(b.x, (2 * q.k + 1)::BIGINT, 2) AS byte FROM b, LATERAL (SELECT unnest(range(b.n)) AS k) q),
g AS (SELECT y.doc_id, y.k, y.byte, coalesce(max(CASE WHEN f.later THEN f.s END) OVER (PARTITION BY y.doc_id ORDER BY y.k ROWS UNBOUNDED PRECEDING), -100) + 99 >= y.k AS gone
      FROM y LEFT JOIN f ON f.doc_id = y.doc_id AND f.s = y.k),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS opens FROM g),
d AS (SELECT doc_id, count(*) FILTER (gone)::BIGINT AS n_removed, count(*) FILTER (opens)::BIGINT AS n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY k) FILTER (NOT gone), ''))) AS kept_sha256 FROM r GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM b LEFT JOIN d USING (doc_id)
"""

_P = "CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END / 2"
_JSD = "sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: " + _P.format(a="{p}[i]", b="{q}[i]") + " + " + _P.format(a="{q}[i]", b="{p}[i]") + ")), 0))"

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text IS NULL AS missing, coalesce(text, '') AS t FROM documents),
langs AS (SELECT lang FROM d WHERE lang IS NOT NULL AND NOT missing GROUP BY lang HAVING count(*) >= 20),
k AS (SELECT rid, doc_id, t, CASE WHEN lang IN (SELECT lang FROM langs) THEN lang ELSE '*' END AS ref, {_WORDS.format('t')} AS ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
b AS (SELECT rid, doc_id, ref, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) AS n_chars, len(regexp_extract_all(t, '[^\\x00-\\x7F]')) AS wide,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '[A-Z]')) AS upper, len(regexp_extract_all(t, '[0-9]')) AS digit,
        len(regexp_extract_all(t, '[.,;:!?''"()-]')) AS mark, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM k),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (SELECT rid, i, array_to_string(ws[i + 1 : i + 8], ' ') AS g FROM (SELECT rid, ws, unnest(range(greatest(n_words - 7, 0))) AS i FROM b))),
rep AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM win, range(8) r(o) WHERE c >= 2 GROUP BY rid),
wc AS (SELECT ref, w, count(*) AS n FROM (SELECT ref, unnest(ws) AS w FROM k) GROUP BY ref, w),
every AS (SELECT ref, w, n FROM wc WHERE ref <> '*' UNION ALL SELECT '*', w, sum(n) FROM wc GROUP BY w),
top AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY n DESC, w) - 1 AS r FROM every WHERE length(w) <= 4 QUALIFY r < 24),
tot AS (SELECT ref, sum(n) AS total FROM every GROUP BY ref),
refs AS (SELECT ref FROM (SELECT lang AS ref FROM langs UNION ALL SELECT '*') z),
wq AS (SELECT refs.ref, list(coalesce(top.n / tot.total, 0)::DOUBLE ORDER BY g.r) AS q FROM refs CROSS JOIN range(24) g(r) LEFT JOIN top ON top.ref = refs.ref AND top.r = g.r LEFT JOIN tot ON tot.ref = refs.ref GROUP BY refs.ref),
cl AS (SELECT rid, ref, [upper, digit, mark, n_symbols, n_chars - word_chars, wide, n_chars - upper - digit - mark - n_symbols - (n_chars - word_chars) - wide] AS v FROM b),
cs AS (SELECT ref, list(s ORDER BY j) AS v FROM (SELECT refs.ref, j, sum(cl.v[j + 1]) AS s FROM refs JOIN cl ON refs.ref = cl.ref OR refs.ref = '*', range(7) g(j) GROUP BY refs.ref, j) GROUP BY ref),
hit AS (SELECT rid, r, count(*) AS n FROM (SELECT rid, ref, unnest(ws) AS w FROM b) x JOIN top USING (ref, w) GROUP BY rid, r),
wp AS (SELECT b.rid, list(coalesce(hit.n, 0)::DOUBLE / greatest(b.n_words, 1) ORDER BY g.r) AS p FROM b CROSS JOIN range(24) g(r) LEFT JOIN hit ON hit.rid = b.rid AND hit.r = g.r GROUP BY b.rid),
v AS (SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
        list_transform(cl.v, lambda x: CASE WHEN list_sum(cl.v) > 0 THEN x::DOUBLE / list_sum(cl.v) ELSE 0 END) AS cp, list_transform(cs.v, lambda x: x::DOUBLE / greatest(list_sum(cs.v), 1)) AS cq,
        list_append(wp.p, greatest(1 - list_sum(wp.p), 0)) AS wpp, list_append(wq.q, greatest(1 - list_sum(wq.q), 0)) AS wqq
      FROM b LEFT JOIN rep USING (rid) JOIN cl USING (rid) JOIN cs ON cs.ref = b.ref JOIN wp ON wp.rid = b.rid JOIN wq ON wq.ref = b.ref),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_JSD.format(p='cp', q='cq')} AS dc, {_JSD.format(p='wpp', q='wqq')} AS dw FROM v)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND (n_words < 50 OR dc <= 0.24) AND (n_words < 100 OR dw <= 0.32) AS kept FROM j
"""

ORACLE_SQL = {"op5_divergence": DIVERGENCE, "op4_line_runs": DIGEST_SQL, "op7_divide_skip": NEAR_DUPLICATES, "op8_bwt_merge": REPEATED_BYTES}
