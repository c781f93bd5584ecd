"""DuckDB SQL for the queries that SQL can express."""

EXACT_DEDUP = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS place FROM sources
), levelled AS (
  SELECT *,
         (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS remains,
         (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left
  FROM placed
), common AS (
  SELECT coalesce(min_by(remains::DOUBLE / weight_left, place), 0.0) AS level
  FROM levelled WHERE most * weight_left >= weight * remains
), targets AS (
  SELECT source, source_size,
         CASE WHEN most * weight_left < weight * remains THEN most::DOUBLE ELSE weight * level END AS target
  FROM levelled, common
), rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS coin
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

QUALITY = r"""
WITH worded AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT rid, size, pos, md5(array_to_string(words[pos:pos + size - 1], ' ')) AS win
  FROM (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS pos
        FROM worded, (VALUES (5), (10), (101)) sizes(size) WHERE len(words) >= size)
), twice AS (
  SELECT rid, size, pos FROM windows
  QUALIFY count(*) OVER (PARTITION BY rid, size, win) > 1
), covered AS (
  SELECT rid, size, count(DISTINCT word) AS n
  FROM (SELECT rid, size, unnest(range(pos, pos + size)) AS word FROM twice) GROUP BY rid, size
), lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM worded)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce((SELECT n FROM lines WHERE lines.rid = worded.rid), 0)::BIGINT AS n_dup_lines,
         coalesce((SELECT n FROM covered c WHERE c.rid = worded.rid AND size = 5), 0)::BIGINT AS n_repeat_words,
         coalesce((SELECT n FROM covered c WHERE c.rid = worded.rid AND size = 10), 0)::BIGINT AS n_covered_words,
         EXISTS (SELECT 1 FROM twice t WHERE t.rid = worded.rid AND size = 101) AS long_repeat
  FROM worded
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
       NOT base_failed AND n_covered_words <= 0.15 * n_words AND NOT long_repeat AS kept
FROM judged
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       -- each turn has 24 characters of template; a control string inside a text takes one more
       sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<_\1|', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

HARD_NEGATIVES = """
WITH vectors AS (
  SELECT row_number() OVER () AS uid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.uid AS anchor_uid, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.uid <> b.uid
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_uid, anchor_id, uid AS positive_uid, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_uid ORDER BY score DESC, vec_id NULLS LAST, uid) <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_uid, p.positive_uid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.uid))::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s USING (anchor_uid)
WHERE NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY rank <= 10
"""

SQL = {
    "op3_exact_dedup": EXACT_DEDUP,
    "op4_mixing": MIXING,
    "op5_quality": QUALITY,
    "op7_chat_format": CHAT,
    "op13_hard_negatives": HARD_NEGATIVES,
}
