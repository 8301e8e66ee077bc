"""SQL for DuckDB that states the queries which SQL can express: frequent lines, benchmark windows, Jaccard components,
the filter audit and hard negatives.

The others are models (3, 9), need a tokenizer file (2, 5), rules over markup (4), keyed digests (6), a hash that it lacks (11) or an
iteration whose result is one of many right ones (10); they are tested against brute force.
"""
from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
SMALL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{1}', 'abcdefghijklmnopqrstuvwxyz{2}')"

OP1 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '{WORDS}') AS w FROM docs),
lines AS (
    SELECT r, source, text, l, len(regexp_extract_all(l, '{WORDS}')) AS n,
        array_to_string(regexp_extract_all({SMALL.format('l', '123456789', '000000000')}, '{WORDS}'), ' ') AS line
    FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '{WORDS}')),
windows AS (
    SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
twice AS (
    SELECT r, count(DISTINCT p) AS n FROM (
        SELECT r, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS times FROM windows) WHERE times > 1)
    GROUP BY r),
frequent AS (
    SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT text) > 10),
gone AS (
    SELECT r, CAST(sum(l.n) AS BIGINT) AS n FROM lines l JOIN frequent f ON f.line = l.line AND f.source IS NOT DISTINCT FROM l.source GROUP BY r),
repeated AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
stats AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(d.n, 0) AS n_dup_lines, coalesce(t.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_removed_words
    FROM words LEFT JOIN repeated d USING (r) LEFT JOIN twice t USING (r) LEFT JOIN gone g USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(n_removed_words AS BIGINT) AS n_removed_words,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= n_words * 0.5 AS kept
FROM stats"""

TOKENS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({SMALL.format("coalesce(text, '')", '', '')}, '{TOKENS}') AS w FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS k FROM (
        SELECT item_id, regexp_extract_all({SMALL.format("coalesce(text, '')", '', '')}, '{TOKENS}') AS w FROM benchmark) WHERE len(w) > 0),
known AS (
    SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT k FROM known),
windows AS (
    SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
hits AS (SELECT r, k, i, item FROM windows JOIN known USING (k, s)),
places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
named AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN places p USING (r) LEFT JOIN named m USING (r)"""

OP8 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({SMALL.format("coalesce(text, '')", '', '')}, '{WORDS}') AS w FROM documents),
sets AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = w.doc_id) AS component_id FROM words w LEFT JOIN sizes USING (doc_id)"""

#: Documents go through the filters one by one in each order; nothing here knows of coalitions.
OP12 = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, part, text, regexp_extract_all(text, '{WORDS}') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM docs),
flags AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM words),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
classes AS (SELECT part, a, b, c, d, e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM flags LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
fails AS (SELECT *, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS failed FROM classes),
met AS (SELECT part, filter_order, step, f, n, good, toxic, failed, contains(failed, f) AS own,
    len(list_intersect(string_split(earlier, ''), string_split(failed, ''))) > 0 AND earlier <> '' AND failed <> '' AS gone FROM fails, steps),
told AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT own), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND own), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND own), 0) AS redundant, coalesce(sum(n) FILTER (WHERE failed = f), 0) AS unique_fails,
    coalesce(sum(n) FILTER (WHERE NOT gone AND own AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE NOT gone AND own AND toxic), 0) AS toxic_lost
    FROM met GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM told"""

#: Rows of a null id are no anchors and stand last among equal scores.
OP13 = """
WITH valid AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
    SELECT r, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM valid),
whole AS (SELECT r, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS q FROM parts),
dots AS (
    SELECT a.r AS anchor, b.r AS r, sum(a.q * b.q) AS score
    FROM whole a JOIN valid v ON v.r = a.r AND v.vec_id % 100 = 0 JOIN whole b ON b.i = a.i AND b.r <> a.r GROUP BY a.r, b.r),
scored AS (
    SELECT x.r AS anchor, x.vec_id AS anchor_id, y.r, y.vec_id, coalesce(score, 0) AS score, x.label = y.label AS same
    FROM valid x JOIN valid y ON x.vec_id % 100 = 0 AND y.r <> x.r LEFT JOIN dots d ON d.anchor = x.r AND d.r = y.r),
positives AS (
    SELECT anchor, anchor_id, r AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5),
negatives AS (
    SELECT p.anchor_id, p.positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY score DESC, vec_id NULLS LAST) AS rank
    FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score,
    CAST(negative_score AS BIGINT) AS negative_score FROM negatives WHERE rank <= 10"""

SQL: dict[str, str] = {"op1_line_frequency": OP1, "op7_decontaminate": OP7, "op8_jaccard": OP8, "op12_filter_audit": OP12, "op13_hard_negatives": OP13}
