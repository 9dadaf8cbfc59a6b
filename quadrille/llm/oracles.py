"""DuckDB SQL for the rows of those corpus queries that SQL can express over whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Windows of 35 words, counted over all documents; every word that a repeated one covers goes.
SUBSTRING = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
  i AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
  w AS MATERIALIZED (SELECT r, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM i),
  twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
  gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM w SEMI JOIN twice USING (h)),
  words AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM d),
  kept AS (SELECT r, string_agg(x, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (r, k) GROUP BY r),
  n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of 8 words of the items, or whole shorter items, looked up among the documents' windows of the same length.
DECONTAMINATE = rf"""
WITH items AS (SELECT item_id, {_FOLDED} AS ws FROM benchmark WHERE item_id IS NOT NULL),
  iw AS (SELECT DISTINCT item_id, least(8, len(ws)) AS n, array_to_string(ws[i : i + 7], ' ') AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 7) + 1)) AS i FROM items WHERE len(ws) > 0)),
  d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_FOLDED} AS ws FROM documents),
  place AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n),
  hits AS MATERIALIZED (SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM place) JOIN iw USING (n, w)),
  covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
  found AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""

#: Exact Jaccard similarity of all sets of 5-word shingles that share one, and the components of the links at 0.8 or more.
JACCARD = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
  s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END)) AS g FROM d WHERE len(ws) > 0),
  own AS MATERIALIZED (SELECT min(doc_id) AS rep, count(*) AS n_copies, g, len(g) AS n FROM s GROUP BY g),
  e AS MATERIALIZED (SELECT rep, n, unnest(g) AS x FROM own),
  link AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
  reach AS (SELECT rep AS a, rep AS b FROM own UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
  class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
  links AS (SELECT a AS rep, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(own.rep, doc_id) AS rep_id, coalesce(n_copies, 1)::BIGINT AS n_copies, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN own ON s.g = own.g LEFT JOIN class ON class.rep = own.rep LEFT JOIN links ON links.rep = own.rep"""
