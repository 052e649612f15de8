"""Independent DuckDB twins of the queries, where SQL can say them."""

from __future__ import annotations

_SPLIT = r"'[\x20\x09-\x0D]+'"

# Words of every text with their positions.
_WORDS = rf"""docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, {_SPLIT}), lambda x: x <> '') AS w FROM docs),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists)"""

OP9 = rf"""
WITH {_WORDS},
tri AS (
  SELECT doc_id, i, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS g FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY i)
),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) v(d) GROUP BY 1),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
),
m AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, {_SPLIT}, '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM lists l LEFT JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)
),
b AS (
  SELECT *, n_words < 50 AS r0, 100 * n_repeat_words > 50 * n_words AS r1, 2 * n_symbols > n_words AS r2, 2 * n_dup_lines > n_lines AS r3,
    word_chars < 2 * n_words AS r4, word_chars > 20 * n_words AS r5 FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT)::BIGINT AS fail_bits,
  r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5) AS kept
FROM b"""

OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)"""

ORACLES = {"op7_near_embeddings": OP7, "op9_quality_rules": OP9}
