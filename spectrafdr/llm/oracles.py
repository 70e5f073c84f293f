"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op7_mixing"] = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, text,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
    SELECT source, source_size, 3.0::DOUBLE * source_size AS lim,
        ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
    FROM sources),
rounds(n, clamped, level_num, level_den) AS (
    SELECT 0, [x FOR x IN [NULL::VARCHAR] IF false], (SELECT sum(source_size)::DOUBLE FROM weighted),
        (SELECT sum(weight) FROM weighted)
    UNION ALL
    SELECT n + 1, (SELECT list(coalesce(w.source, chr(1))) FROM weighted w
                   WHERE w.weight * (level_num / level_den) > w.lim OR list_contains(clamped, coalesce(w.source, chr(1)))),
        (SELECT sum(source_size) - coalesce(sum(CASE WHEN w.weight * (level_num / level_den) > w.lim
             OR list_contains(clamped, coalesce(w.source, chr(1))) THEN w.lim END), 0) FROM weighted w)::DOUBLE,
        (SELECT sum(CASE WHEN w.weight * (level_num / level_den) > w.lim
             OR list_contains(clamped, coalesce(w.source, chr(1))) THEN 0 ELSE w.weight END) FROM weighted w)
    FROM rounds
    WHERE n < 1000 AND level_den > 0 AND EXISTS (SELECT 1 FROM weighted w
        WHERE w.weight * (level_num / level_den) > w.lim AND NOT list_contains(clamped, coalesce(w.source, chr(1))))),
final AS (SELECT * FROM rounds ORDER BY n DESC LIMIT 1),
targets AS (
    SELECT w.source, w.source_size,
        CASE WHEN list_contains(f.clamped, coalesce(w.source, chr(1))) THEN w.lim
             WHEN f.level_den > 0 THEN f.level_num * w.weight / f.level_den ELSE 0.0 END AS target
    FROM weighted w, final f),
placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size, md5(s.text)
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CAST(CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
        + greatest(0, least(size, words % source_size - earlier)) END AS BIGINT) AS taken
FROM placed
"""

ORACLES["op5_quality_rules"] = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (
    SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM texts),
windows AS (
    SELECT r, i, array_to_string(w[i:i+4], ' ') AS s
    FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS x(k) GROUP BY r),
measured AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
        length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower
    FROM worded LEFT JOIN covered USING (r)),
flags AS (
    SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 5 * n_symbols > 2 * n_words THEN 4 ELSE 0 END)
        + (CASE WHEN n_dup_lines > 3 AND 10 * n_dup_lines > 6 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN n_upper > n_lower THEN 64 ELSE 0 END) AS bits
    FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    bits & 3 <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS failed
FROM flags
"""

ORACLES["op8_topk"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, p.vec_id,
        CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * p.v[i])) AS BIGINT) AS score
    FROM usable q JOIN usable p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
ranked AS (
    SELECT query_id, vec_id, score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op11_hard_negatives"] = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
    FROM usable a JOIN usable c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
    SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
