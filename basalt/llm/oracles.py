"""DuckDB SQL of the queries that SQL can express."""
from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
t AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT t.y, r.root FROM r JOIN t ON t.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, count(*) OVER (PARTITION BY component_id) AS component_size FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""

#: The same, with links counted and equal sets as classes.
JACCARD_LINKS = f"""
{JACCARD[: JACCARD.rindex("SELECT c.doc_id")].strip()},
l AS (SELECT x AS doc_id, count(*) AS n_links FROM t GROUP BY x),
k AS (SELECT doc_id, list_sort(list(s)) AS k FROM s GROUP BY doc_id),
g AS (SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS class_size FROM k WINDOW w AS (PARTITION BY k))
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(class_id, c.doc_id) AS class_id, coalesce(class_size, 1) AS class_size, coalesce(n_links, 0) AS n_links, component_id, count(*) OVER (PARTITION BY component_id) AS component_size
FROM c LEFT JOIN n ON n.doc_id = c.doc_id LEFT JOIN l ON l.doc_id = c.doc_id LEFT JOIN g ON g.doc_id = c.doc_id"""

#: Every 50 bytes of every text, in hexadecimal, cut out of pieces of 1049 bytes.
REPEATS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT doc_id, k * 1000 AS base, h[2000 * k + 1 : 2000 * k + 2098] AS c FROM (SELECT doc_id, h, unnest(range((n + 950) // 1000)) AS k FROM h)),
s AS (SELECT doc_id, base + j AS i, c[2 * j + 1 : 2 * j + 100] AS g FROM (SELECT *, unnest(range(least(1000, len(c) // 2 - 49))) AS j FROM b)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
p AS (SELECT s.doc_id, i, coalesce(i > 50 + lag(i) OVER (PARTITION BY s.doc_id ORDER BY i), true) AS new FROM s JOIN f ON f.g = s.g WHERE first < s.doc_id),
r AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
q AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run),
g AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y, max(z) OVER (PARTITION BY doc_id) AS m FROM q),
k AS (SELECT g.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(h[2 * y + 1 : 2 * a], '' ORDER BY a) || any_value(h[2 * m + 1 :]) AS kept FROM g JOIN h ON h.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT h.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM h LEFT JOIN k ON k.doc_id = h.doc_id"""


def secrets_sql() -> str:
    """The secret scan, its models' training included."""
    from basalt.llm import secrets

    def quoted(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    def spans(name: str, pattern: str, rank: int, group: int = 0) -> str:
        p = quoted(pattern)
        return f"""{name} AS (SELECT doc_id, {rank} AS k, a AS a, a + length(m) AS z, m, v FROM (
  SELECT doc_id, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, ms[i] AS m, vs[i] AS v
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, {p}) AS p, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS vs FROM docs))))"""

    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
dig AS (SELECT id, sha256('sample' || id) AS d, to_base64(unhex(sha256('sample' || id))) AS b FROM range(3000) r(id)),
wl AS (SELECT regexp_extract_all(text, '[A-Za-z]{{2,}}') AS w FROM benchmark),
pr AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM wl)),
samples AS (
  SELECT CASE id % 3 WHEN 0 THEN b WHEN 1 THEN regexp_replace(b, '[+/=]', '', 'g') ELSE d END AS s, 1 AS y FROM dig
  UNION ALL SELECT unnest([a, lower(a) || '_' || lower(b), lower(a) || '-' || lower(b), lower(a) || upper(b[1]) || lower(b[2:]), upper(a || '_' || b), lower(a) || '/' || lower(b), lower(a) || lower(b)]), 0 FROM pr),
bi AS (SELECT y, s[i] AS a, s[i + 1] AS b FROM (SELECT y, s, unnest(range(1, length(s))) AS i FROM samples)),
n2 AS (SELECT y, a, b, count(*) AS n FROM bi GROUP BY y, a, b),
n1 AS (SELECT y, a, count(*) AS n FROM bi GROUP BY y, a),
{spans("s0", secrets.ASSIGN, 0, 1)},
{spans("s1", secrets.ACCESS, 1)},
{spans("s2", secrets.HEX, 2)},
{spans("s3", secrets.RANDOM, 3)},
base AS (SELECT doc_id, k, a, z FROM s0 WHERE length(v) >= 6 UNION ALL SELECT doc_id, k, a, z FROM s1 UNION ALL SELECT doc_id, k, a, z FROM s2),
cand AS (SELECT DISTINCT m FROM s3),
cp AS (SELECT m, m[i] AS a, m[i + 1] AS b FROM (SELECT m, unnest(range(1, length(m))) AS i FROM cand)),
sc AS (SELECT cp.m, sum(round(1000 * (ln((coalesce(p.n, 0) + 0.5) / (coalesce(pt.n, 0) + 0.5 * 67)) - ln((coalesce(q.n, 0) + 0.5) / (coalesce(qt.n, 0) + 0.5 * 67))))) AS s
  FROM cp LEFT JOIN n2 p ON p.y = 1 AND p.a = cp.a AND p.b = cp.b LEFT JOIN n1 pt ON pt.y = 1 AND pt.a = cp.a LEFT JOIN n2 q ON q.y = 0 AND q.a = cp.a AND q.b = cp.b LEFT JOIN n1 qt ON qt.y = 0 AND qt.a = cp.a GROUP BY cp.m),
rnd AS (SELECT s3.doc_id, k, a, z FROM s3 JOIN sc ON sc.m = s3.m WHERE sc.s >= (length(s3.m) - 1) * 250 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s3.doc_id AND b.a < s3.z AND s3.a < b.z)),
tag AS (SELECT doc_id, k, a, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || a || ':' || z AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM rnd)),
agg AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(x, ',' ORDER BY a, k) FILTER (k < 3) AS b, string_agg(x, ',' ORDER BY a, k) AS s FROM tag GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM docs LEFT JOIN agg ON agg.doc_id = docs.doc_id"""
