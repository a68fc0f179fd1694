"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

# Pairs of different lines of like length, compared directly. Two edits leave the first 8 or the last 8
# characters alone, or else one falls into each, and the characters between are whole.
LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), d AS (
  SELECT line, length(line) AS len, min({'doc': doc_id, 'no': line_no}) AS place, count(*) AS n FROM l WHERE length(line) >= 30 OR regexp_matches(line, '\p{L}') GROUP BY line
), near AS (
  SELECT a.line, b.place AS other FROM d a JOIN d b ON b.len BETWEEN a.len - 2 AND a.len + 2 AND a.line <> b.line AND a.len >= 30 AND b.len >= 30
  WHERE (left(a.line, 8) = left(b.line, 8) OR right(a.line, 8) = right(b.line, 8)
         OR contains(b.line, substr(a.line, 9, 7)))
    AND levenshtein(a.line, b.line) <= 2
), k AS (
  SELECT d.line, d.place, d.n, min(near.other) AS close, count(near.other) AS n_links FROM d LEFT JOIN near ON near.line = d.line GROUP BY ALL
), m AS (
  SELECT l.doc_id, l.line_no, l.line, k.n_links, least(k.place, coalesce(k.close, k.place)) AS rep, k.n > 1 OR k.close IS NOT NULL AS listed
  FROM l LEFT JOIN k ON k.line = l.line
), f AS (
  SELECT *, coalesce(listed AND (rep.doc <> doc_id OR rep.no <> line_no), false) AS dropped FROM m
), p AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT dropped) AS kept, count(*) FILTER (dropped) AS n_dropped,
    list({'line_no': line_no::INT, 'rep_doc': rep.doc, 'rep_line': rep.no::INT, 'n_links': n_links, 'dropped': dropped} ORDER BY line_no) FILTER (listed) AS classes
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN n_dropped > 0 THEN coalesce(kept, '') ELSE d.text END AS text, coalesce(n_dropped, 0) AS n_dropped, coalesce(classes, []) AS line_classes
FROM documents d LEFT JOIN p USING (doc_id)
"""

DECONTAMINATE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), runs AS (
  SELECT item_id, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS spot, words FROM b WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(words, spot, spot + n - 1), ' ') AS win FROM runs
), spots AS (
  SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS spot FROM w, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n
), hits AS (
  SELECT s.doc_id, s.spot, s.n, v.item_id FROM spots s JOIN windows v ON v.n = s.n AND v.win = array_to_string(list_slice(s.words, s.spot, s.spot + s.n - 1), ' ')
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS p FROM (SELECT DISTINCT doc_id, spot, n FROM hits)) GROUP BY doc_id
)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN items USING (doc_id) LEFT JOIN covered USING (doc_id)
"""

TOP_K = r"""
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score FROM q a, q b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# Every kept term times every group; a group and a term it does not use count 0.
DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT row_no, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT row_no) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS in_lang
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s)::BIGINT AS p,
    1 + (1000000000 * (in_lang + 2)) // (sum(in_lang) OVER s + 2 * count(*) OVER s)::BIGINT AS q
  FROM dense WINDOW s AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""

ORACLES = {"op13_divergence": DIVERGENCE, "op2_line_dedup": LINE_DEDUP, "op4_decontaminate": DECONTAMINATE, "op5_top_k": TOP_K}
