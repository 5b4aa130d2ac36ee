"""Reference SQL of queries whose rows plain joins can express on small tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Vectors that take part: not null, all components finite.
SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

EXACT_SEARCH = f"""
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE {SOUND}),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: What a table of pairs (a, b) of ids reaches: (id, least), following links both ways.
REACHED = """linked AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(x, y) AS (SELECT x, y FROM linked UNION SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x),
least AS (SELECT x AS id, min(y) AS least FROM reach GROUP BY x)"""

LATTICE_DEDUP = f"""
WITH RECURSIVE kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND {SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM kept a JOIN kept b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
{REACHED},
links AS (SELECT x AS id, count(*) AS n FROM linked GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN links ON links.id = vec_id LEFT JOIN least ON least.id = vec_id
"""

ODD_SKETCH_DEDUP = rf"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, CAST(len(w) AS BIGINT) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM worded),
sets AS (SELECT doc_id, len(s) AS n FROM shingled),
items AS (SELECT doc_id, unnest(s) AS item FROM shingled),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id
    GROUP BY ALL),
pairs AS (
    SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
{REACHED}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id,
    doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
FROM sets LEFT JOIN least ON least.id = doc_id
"""
