"""DuckDB twins of the queries that SQL can express."""

#: Words of op3 and op8: A-Z lower-cased, runs outside 00-2F, 3A-60 and 7B-7F.
WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text="text")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
      FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b, c = na AND c = nb AS same FROM p WHERE c >= 0.8 * (na + nb - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, (SELECT min(b) FROM link WHERE a = d.doc_id AND same)) AS class_id,
       (SELECT count(*) FROM link WHERE a = d.doc_id) AS n_links, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS group_id
FROM documents d
"""

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format(text="text")}, []) AS w FROM documents),
i AS (SELECT DISTINCT item_id, {WORDS.format(text="text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k+least(10, len(w))-1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0)),
t AS (SELECT doc_id, n, k, array_to_string(w[k:k+n-1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT doc_id, item_id, k, p.n FROM t JOIN p ON t.n = p.n AND t.g = p.g),
x AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""

OP2 = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP6 = r"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents),
t AS (SELECT source, lang, unnest(['letters-1', 'space-1', 'word-1']) AS version,
             unnest([len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\x09-\x0D\x20\p{L}\p{N}]+')), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')),
                     len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+'))]) AS tokens
      FROM d WHERE k = 1 OR text IS NULL)
SELECT source, lang, version, count(*) AS documents, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM t GROUP BY ALL
"""
