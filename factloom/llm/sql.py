"""DuckDB SQL for the queries that SQL can express."""

OP8 = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(h, p, verdict, own) AS (
  VALUES ('org', '/', 'allow', 0), ('example.org', '/es/', 'block', 0), ('example.org', '/en/1', 'block', 0),
         ('com', '/fr/', 'allow', 0), ('com', '/de/', 'block', 0),
         ('adult-x.example.com', '/', 'block', 1), ('casino-win.example.net', '/', 'block', 1), ('ads-track.example.com', '/', 'block', 1)
)
SELECT page_id, host, path,
       (SELECT h || p FROM rules WHERE own = 0 AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY own, length(h || p) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""

OP7 = r"""
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 5
"""

OP4 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded
), shingles AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * k >= 80 * (len(x.s) + len(y.s) - k)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON r.other = l.a
), lowest AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN lowest USING (doc_id)
"""

ORACLES: dict[str, str] = {"op4_jaccard_join": OP4, "op7_exact_top_k": OP7, "op8_url_filter": OP8}
