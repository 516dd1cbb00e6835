"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = f"""
    WITH w AS (SELECT doc_id, {_WORDS.format(text="text")} AS ws FROM documents),
    places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
    windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS x FROM places),
    least AS (SELECT x, min(doc_id) AS m FROM windows GROUP BY x),
    covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN least USING (x) WHERE m < doc_id),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
    kept AS (
        SELECT doc_id, count(c.k) AS n_removed, string_agg(word, ' ' ORDER BY words.k) FILTER (c.k IS NULL) AS text
        FROM words LEFT JOIN covered c USING (doc_id, k) GROUP BY doc_id
    )
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
"""


def _components(size: int, percent: int, more: str = "") -> str:
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(ws) >= {size} THEN list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i : i + {size - 1}], ' '))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x
        FROM w
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
        WHERE 100 * i >= {percent} * (p.n + q.n - i)
    ),
    reached(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, c FROM reached JOIN links ON a = doc_id),
    parts AS (SELECT doc_id, min(c) AS component_id FROM reached GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id{more}
    FROM parts LEFT JOIN sizes USING (doc_id)
"""


JACCARD = _components(5, 75)
BOTTOM_K = _components(3, 85, ", component_id = doc_id AS kept")

NEGATIVES = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.e, b.e)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ),
    p AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT anchor_id, positive_id, (row_number() OVER best)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY row_number() OVER best <= 5
"""

ORACLE_SQL: dict[str, str] = {"op1_substrings": SUBSTRINGS, "op6_jaccard": JACCARD, "op11_bottom_k": BOTTOM_K, "op13_negatives": NEGATIVES}
