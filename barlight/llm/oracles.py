"""DuckDB SQL of the opN_<name> queries that SQL expresses, over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_JOIN = rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(1, len(w) - 4) + 1)])) END AS s
  FROM cut
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs WHERE 100 * c >= 75 * (nx + ny - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT l.y, r.root FROM reach r JOIN both_ways l ON l.x = r.doc_id WHERE r.root < l.y
), components AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
), classes AS (
  SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM sets
), counted AS (
  SELECT l.x AS doc_id, count(DISTINCT b.class_id) AS n_links
  FROM both_ways l JOIN classes a ON l.x = a.doc_id JOIN classes b ON l.y = b.doc_id WHERE a.class_id <> b.class_id GROUP BY l.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, k.class_id, coalesce(n.n_links, 0) AS n_links
FROM sets s JOIN components c ON s.doc_id = c.doc_id JOIN classes k ON s.doc_id = k.doc_id LEFT JOIN counted n ON s.doc_id = n.doc_id
"""

TOP_K = """
WITH vectors AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH docs AS (
  SELECT doc_id, {_TERMS} AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows))
), hits AS (
  SELECT doc_id, i, size, item FROM places JOIN windows USING (size, k)
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id
), met AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN met m ON d.doc_id = m.doc_id
"""

WARC = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), firsts AS (
  SELECT page_id, html, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM payloads
)
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM firsts
"""

#: Line report: exact repeats by text, near ones of five words or more by one replaced, added or missing word through the shared deletion variants.
LINE_REPORT = r"""
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT DISTINCT doc_id, i - 1 AS pos, trim(ls[i], ' ') AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM cut)
  WHERE doc_id IS NOT NULL AND trim(ls[i], ' ') <> ''
), texts AS (
  SELECT line, min({'d': doc_id, 'pos': pos}) AS first, string_split(line, ' ') AS w FROM lines GROUP BY line
), compared AS (
  SELECT * FROM texts WHERE len(w) >= 5
), variants AS (
  SELECT line, first, len(w) AS n, 0 AS gone, array_to_string(w, ' ') AS k FROM compared
  UNION ALL
  SELECT line, first, n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ')
  FROM (SELECT line, first, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM compared)
), near AS (
  SELECT a.first AS first
  FROM variants a JOIN variants b ON a.k = b.k AND b.first < a.first AND a.line <> b.line
    AND ((a.n = b.n AND a.gone = b.gone) OR (a.n <> b.n AND (a.gone = 0 OR b.gone = 0)))
  GROUP BY a.first
), dropped AS (
  SELECT l.doc_id, l.pos, 1 AS exact FROM lines l JOIN texts t ON l.line = t.line WHERE {'d': l.doc_id, 'pos': l.pos} > t.first
  UNION ALL
  SELECT first.d, first.pos, 0 FROM near
), per AS (
  SELECT doc_id, sum(exact)::BIGINT AS n_exact, sum(1 - exact)::BIGINT AS n_near, list(pos::INTEGER ORDER BY pos) AS dropped FROM dropped GROUP BY doc_id
)
SELECT c.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(dropped, []::INTEGER[]) AS dropped
FROM cut c LEFT JOIN per p ON c.doc_id = p.doc_id
"""

SQL = {
    "op1_ngram_jaccard_join": JACCARD_JOIN,
    "op2_exact_top_k_search": TOP_K,
    "op7_benchmark_decontamination": CONTAMINATION,
    "op8_warc": WARC,
    "op9_line_dedup": LINE_REPORT,
}
