"""DuckDB SQL for those contract queries that SQL can express, on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

_OP1 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, list_slice(ws, p, p + n - 1) AS win FROM (
  SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0))),
dw AS (SELECT doc_id, p, n, list_slice(ws, p, p + n - 1) AS win FROM (
  SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS k FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS c, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.c, 0) AS n_hit, coalesce(i.c, 0) AS n_items, sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.c, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_OP7 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 12), ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)),
f AS (SELECT x, min(doc_id) AS m FROM win GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS k FROM win JOIN f USING (x) WHERE m < doc_id),
each AS (SELECT doc_id, k, word, g.k IS NOT NULL AS dropped FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM w) LEFT JOIN gone g USING (doc_id, k)),
kept AS (SELECT doc_id, count(*) FILTER (dropped) AS r, string_agg(word, ' ' ORDER BY k) FILTER (NOT dropped) AS s FROM each GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + least(3, len(ws)) - 1), ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM pair JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * pair.c >= 90 * (nu.c + nv.c - pair.c)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT u AS a, u AS b FROM edge UNION SELECT reach.a, edge.v FROM reach JOIN edge ON reach.b = edge.u),
least_ AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.c, 0) AS n_shingles, coalesce(m, doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""

SQL: dict[str, str] = {"op1_suffix_decontamination": _OP1, "op7_repeated_spans": _OP7, "op10_ngram_jaccard": _OP10}
