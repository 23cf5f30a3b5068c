"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from .mixing import FLATTENING
from .secret_scan import ACCESS, ASSIGN, HEX, LEAST, OPAQUE, WIDELY_COPIED_OWNERS

AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, {AZ} AS norm FROM documents)
"""

# the URL's host with its labels reversed, its path and query; pages without a capture time have one made of their id
OP9 = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response_id, regexp_extract(url, '^[a-z]+://([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) AS u, strftime(make_timestamp((1704067200 + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM pages),
k AS (SELECT *, CASE WHEN url IS NULL THEN 'urn:page:' || page_id WHEN u.host = '' THEN url ELSE array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || ')' || CASE WHEN u.path = '' THEN '/' ELSE u.path END || u.query END AS url_key FROM p)
SELECT page_id,
       CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       sha1(payload) AS payload_digest,
       CASE WHEN strlen(payload) >= 1000 AND page_id <> response_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(payload) >= 1000 AND page_id <> response_id THEN response_id END AS refers_to,
       url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) AS history_rank
FROM k
"""


def _matches(order: int, kind: str, pattern: str, group: int) -> str:
    p = pattern.replace("\\x20", " ").replace("'", "''")
    return f"SELECT rid, owner, {order} AS ko, '{kind}' AS kind, {LEAST[kind]} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')"


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
k AS ({_matches(0, "assign", ASSIGN, 2)} UNION ALL {_matches(1, "access", ACCESS, 0)} UNION ALL {_matches(2, "hex", HEX, 0)} UNION ALL {_matches(3, "opaque", OPAQUE, 0)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
s AS (SELECT rid, owner, ko, kind, least, m[i] AS mm, v[i] AS vv, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM i),
f AS (SELECT rid, owner, ko, kind, vv, a, a + length(mm) AS b FROM s WHERE length(vv) >= least AND (kind <> 'opaque' OR (regexp_matches(vv, '[0-9]') AND regexp_matches(vv, '[A-Za-z]')))),
h AS (SELECT vv, count(DISTINCT owner) AS owners, count(*) FILTER (kind <> 'opaque') AS base FROM f GROUP BY vv),
j AS (SELECT f.*, CASE WHEN owners >= {WIDELY_COPIED_OWNERS} THEN 'example' WHEN owners > 1 THEN 'shared' ELSE 'live' END AS standing, base FROM f JOIN h ON f.vv = h.vv),
c AS (SELECT j.* FROM j WHERE kind <> 'opaque' OR ((base > 0 OR standing = 'live') AND NOT EXISTS (SELECT 1 FROM f b WHERE b.rid = j.rid AND b.kind <> 'opaque' AND b.a < j.b AND j.a < b.b))),
o AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ko) FILTER (kind <> 'opaque'), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ko) AS spans,
 count(*) FILTER (standing = 'live') AS n_live, count(*) FILTER (standing = 'shared') AS n_shared, count(*) FILTER (standing = 'example') AS n_example FROM c GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN o USING (rid)
"""

OP10 = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM n),
f AS (SELECT k, min(doc_id) AS m FROM k GROUP BY k),
g AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM k JOIN f USING (k) WHERE m < doc_id),
a AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
b AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY a.p) FILTER (g.p IS NULL) AS kept, count(g.p) AS n_removed FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN b ON w.doc_id = b.doc_id
"""

LINE = "trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM d),
c AS (SELECT rid, doc_id, i, {LINE} AS t FROM l WHERE {LINE} <> ''),
n AS (SELECT *, lead(t) OVER w AS t2, lead(i) OVER w AS i2 FROM c WINDOW w AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i, i2, row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, rid, i) AS k FROM n WHERE t2 IS NOT NULL),
g AS (SELECT rid, i FROM f WHERE k > 1 UNION SELECT rid, i2 FROM f WHERE k > 1),
o AS (SELECT l.rid, string_agg(x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS gone, count(*) AS n FROM l LEFT JOIN g ON l.rid = g.rid AND l.i = g.i GROUP BY l.rid)
SELECT doc_id, n AS n_lines, gone AS n_removed, CASE WHEN gone = 0 THEN text ELSE coalesce(kept, '') END AS text FROM d JOIN o USING (rid)
"""

OP7 = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w),
c AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g, count(*) AS n FROM i GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN t u ON u.doc_id = x JOIN t v ON v.doc_id = y WHERE m / (u.total + v.total - m) >= 0.8),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM k
"""

# brute force; the query is exact too on a table that fills a single list, as that of sf0.01 does
OP8 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

MARGINALS = f"""
WITH d AS (SELECT coalesce(source, '(other)') AS source, coalesce(lang, '(other)') AS lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM documents),
m AS (SELECT 'source' AS marginal, source AS value, sum(n) AS n FROM d GROUP BY ALL UNION ALL SELECT 'lang', lang, sum(n) FROM d GROUP BY ALL),
p AS (SELECT *, pow(n / sum(n) OVER (PARTITION BY marginal), {FLATTENING}) AS w FROM m)
SELECT marginal, value, CAST(n AS BIGINT) AS n_tokens, round(w / sum(w) OVER (PARTITION BY marginal), 6) AS share FROM p
"""

INVARIANTS = "SELECT DISTINCT doc_id, TRUE AS whole, TRUE AS gapless FROM documents"

RECALL = """
WITH v AS (SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT CAST(sum(least(20, (SELECT count(*) FROM v) - 1)) AS BIGINT) AS neighbours, TRUE AS recalled FROM v WHERE vec_id % 20 = 0
"""

ORACLES: dict[str, str] = {"op1_secret_scan": OP1, "op2_line_dedup": OP2, "op6_exact_dedup": OP6, "op7_minhash_near_dedup": OP7, "op8_vector_search": OP8, "op9_warc_index_merge": OP9, "op10_substring_dedup": OP10, "mixing_marginals": MARGINALS, "packing_invariants": INVARIANTS, "vector_search_recall": RECALL}
