"""SQL for DuckDB of those training-data queries that SQL can express, written from their definitions."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lower(column: str) -> str:
    return _LOWER.format(column)


DIVERGENCE = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all({_lower("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
    FROM documents
), words AS (SELECT row_id, lang, source, unnest(found) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
pieces AS (SELECT DISTINCT lang, source FROM docs),
met AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
    SELECT lang, source, term, coalesce(c, 0) AS c FROM pieces JOIN kept USING (lang) LEFT JOIN met USING (lang, source, term)
), shares AS (
    SELECT lang, source, term, c,
           1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p
    FROM cells JOIN vocabulary USING (lang)
), overall AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
    FROM cells JOIN vocabulary USING (lang) GROUP BY lang, term
), apart AS (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
    FROM pieces x JOIN pieces y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
), more AS (
    SELECT lang, source, 'term' AS part, term AS item, p - q AS value
    FROM shares JOIN overall USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR place <= 50
"""

DECONTAMINATION = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, words, least(10, len(words)) AS size FROM (
        SELECT item_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
    WHERE len(words) > 0
), windows AS (
    SELECT DISTINCT item, size, array_to_string(words[k : k + size - 1], ' ') AS piece
    FROM (SELECT item, size, words, unnest(range(1, len(words) - size + 2)) AS k FROM items)
), words AS (SELECT row_id, len(words) AS total, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM docs),
runs AS (
    SELECT row_id, total, k, [word, {", ".join(f"lead(word, {n}) OVER own" for n in range(1, 10))}] AS run
    FROM words WINDOW own AS (PARTITION BY row_id ORDER BY k)
), places AS (
    SELECT row_id, size, k, array_to_string(run[1 : size], ' ') AS piece
    FROM runs, (SELECT DISTINCT size FROM windows) WHERE k + size - 1 <= total
), found AS (SELECT row_id, k, size, item FROM places JOIN windows USING (size, piece)),
hits AS (SELECT row_id, count(DISTINCT word) AS n_hit FROM (SELECT row_id, unnest(range(k, k + size)) AS word FROM found) GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listing FROM (SELECT DISTINCT row_id, item FROM found) GROUP BY row_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listing, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)
"""

PHRASES = rf"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (SELECT piece_id, lang, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM pieces),
starts AS (
    SELECT lang, word, lead(word) OVER own AS second, lead(word, 2) OVER own AS third FROM words WINDOW own AS (PARTITION BY piece_id ORDER BY k)
), grams AS (
    SELECT lang, size, CASE size WHEN 1 THEN word WHEN 2 THEN word || ' ' || second ELSE word || ' ' || second || ' ' || third END AS phrase, count(*) AS f
    FROM starts, (SELECT unnest([1, 2, 3]) AS size) WHERE size = 1 OR (size = 2 AND second IS NOT NULL) OR third IS NOT NULL GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM grams WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE size >= 2 AND f >= 10),
covered AS (
    SELECT DISTINCT s.lang, s.phrase
    FROM candidates s JOIN candidates t
      ON s.lang = t.lang AND s.size = 2 AND t.size = 3 AND 100 * t.f >= 50 * s.f
     AND (s.phrase = t.w[1] || ' ' || t.w[2] OR s.phrase = t.w[2] || ' ' || t.w[3])
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, left_part.f AS l, right_part.f AS r,
           (1000000::HUGEINT * c.f * c.f) // (left_part.f::HUGEINT * right_part.f) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN grams left_part ON left_part.lang = c.lang AND left_part.phrase = array_to_string(c.w[1 : k], ' ')
    JOIN grams right_part ON right_part.lang = c.lang AND right_part.phrase = array_to_string(c.w[k + 1 : c.size], ' ')
    WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.lang = c.lang AND v.phrase = c.phrase)
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM best)
SELECT lang, place AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE place <= 2000
"""

ORACLE: dict[str, str] = {
    "op11_prefix_divergence": DIVERGENCE,
    "op12_automaton_decontamination": DECONTAMINATION,
    "op13_graph_phrases": PHRASES,
}
