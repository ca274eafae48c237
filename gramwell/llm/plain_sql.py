"""DuckDB SQL for the queries whose rows plain SQL can express without their methods.

Each compares texts themselves: windows of words, sets of shingles, or strings of 100 bytes by their md5.
"""

from __future__ import annotations

_WORDS = "list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}', ' ', 'g'), ' '), lambda x: x <> '')"
_ASCII_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANKS = r"[\x20\x09-\x0D]+"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_ASCII_GAPS)} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(_ASCII_GAPS)} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[s + 1 : s + 8], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 7, 1))) AS s FROM i WHERE len(w) > 0)),
c AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT doc_id, s, n, item_id FROM c JOIN p USING (n, x)),
k AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
c AS (SELECT doc_id, start, substring(h, 2 * start + 1, 1198) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 500)) AS start FROM d WHERE length(h) >= 200)),
s AS (SELECT doc_id, start + i AS place, md5_number(substring(h, 2 * i + 1, 200)) AS x FROM (SELECT doc_id, start, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM c)),
r AS (SELECT doc_id, place FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, place) > 1),
b AS (SELECT doc_id, place, place > coalesce(lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 100, -1) AS fresh FROM r),
u AS (SELECT doc_id, place, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM b),
e AS (SELECT doc_id, run, min(place) AS a, max(place) + 100 AS z FROM u GROUP BY doc_id, run),
g AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM e),
k AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANKS}', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n, list_sort(list(x)) AS xs FROM s GROUP BY doc_id),
v AS (SELECT xs, n, min(doc_id) AS v FROM c GROUP BY xs, n),
e AS (SELECT v, n, unnest(xs) AS x FROM v),
o AS (SELECT a.v AS a, b.v AS b, any_value(a.n + b.n) AS n, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.v < b.v AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.v, b.v),
l AS (SELECT a, b FROM o WHERE 100 * shared >= 85 * (n - shared) UNION ALL SELECT b, a FROM o WHERE 100 * shared >= 85 * (n - shared)),
t(a, b) AS (SELECT v, v FROM v UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
m AS (SELECT a, min(b) AS head FROM t GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(m.head, d.doc_id) AS component_id
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN v ON c.xs = v.xs LEFT JOIN m ON m.a = v.v
"""
