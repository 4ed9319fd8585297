"""SQL for the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIVE = "('0x' || substr(h, 5 * i + 1, 5))::BIGINT"
_BASE32 = "array_to_string([" + ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> {s}) & 31)::INTEGER, 1)" for s in (15, 10, 5, 0)) + "], '')"

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(list_transform(range(8), lambda i: {_FIVE}), lambda x: {_BASE32}), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 1000000000), '%Y%m%d%H%M%S') AS "timestamp"
FROM d"""

OP2 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS k FROM windows JOIN firsts USING (h) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM docs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""

_OP9_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
OP9 = f"""
WITH docs AS (SELECT doc_id, {_OP9_WORDS} FROM documents),
items AS (SELECT item_id, {_OP9_WORDS} FROM benchmark),
windows AS (SELECT DISTINCT item_id, v, len(v) AS n FROM (SELECT item_id, w[s:s + 12] AS v FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM items WHERE len(w) > 0))),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM docs),
hits AS (SELECT DISTINCT doc_id, s, p.n, item_id FROM (SELECT doc_id, s, n, w[s:s + n - 1] AS v FROM places, (SELECT DISTINCT n FROM windows) WHERE s + n - 1 <= len(w)) p JOIN windows USING (v)),
counts AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id),
df AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM docs) GROUP BY x),
rarest AS (SELECT v, arg_min(x, (c, x)) AS x FROM (SELECT v, x, coalesce(c, 0) AS c FROM (SELECT DISTINCT v, unnest(v) AS x FROM windows) LEFT JOIN df USING (x)) GROUP BY v HAVING min(c) > 0),
around AS (SELECT DISTINCT v, doc_id, w, unnest(range(greatest(1, s - 25), s + 1)) AS s FROM rarest JOIN (SELECT doc_id, w, s, w[s] AS x FROM places) USING (x)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM around JOIN windows USING (v) WHERE list_has_all(w[s:s + 25], v) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)"""
