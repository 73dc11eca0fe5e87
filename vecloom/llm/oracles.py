"""DuckDB SQL for the operators that SQL can express on its own."""

from __future__ import annotations

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
 s AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM p),
 k AS (SELECT doc_id, pos, array_to_string(l, ' ') AS t FROM s WHERE len(l) = 13),
 m AS (SELECT t, min(doc_id) AS first FROM k GROUP BY t),
 g AS (SELECT DISTINCT k.doc_id, k.pos + j AS pos FROM k JOIN m USING (t), range(13) r(j) WHERE m.first < k.doc_id),
 f AS (SELECT p.doc_id, count(*) AS n, count(g.pos) AS gone, string_agg(CASE WHEN g.pos IS NULL THEN word END, ' ' ORDER BY p.pos) AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN f USING (doc_id)
"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
 s AS (SELECT doc_id, n, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l, pos FROM p),
 g AS (SELECT doc_id, array_to_string(l, ' ') AS t, count(*) AS c FROM s WHERE len(l) = 5 OR (n < 5 AND pos = 1) GROUP BY ALL),
 z AS (SELECT doc_id, sum(c) AS n FROM g GROUP BY doc_id),
 o AS (SELECT a.doc_id AS u, b.doc_id AS v, sum(least(a.c, b.c)) AS low FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT u, v FROM o JOIN z za ON za.doc_id = u JOIN z zb ON zb.doc_id = v WHERE low >= 0.8 * (za.n + zb.n - low)),
 y AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
 r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT y.v, r.c FROM r JOIN y ON y.u = r.doc_id)
SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id
"""

_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n[{k}] >> {s}) & 31)::INT + 1, 1)" for k in range(1, 9) for s in (15, 10, 5, 0))

OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
 b AS (SELECT page_id, strlen(h) AS payload_bytes, x, list_transform(range(8), lambda i: ('0x' || substr(x, i * 5 + 1, 5))::BIGINT) AS n FROM p),
 m AS (SELECT x, max(page_id) AS top FROM p GROUP BY x)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b JOIN m USING (x)
"""
