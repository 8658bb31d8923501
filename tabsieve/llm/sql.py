"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {
    "op1_preference_chat": """
WITH turns AS (
    SELECT DISTINCT {'id': conv_id, 'lone': CASE WHEN conv_id IS NULL THEN sha256(coalesce(turn::VARCHAR, '-') || ':' || role || ':' || text) END} AS conv_id,
           turn, role, text
    FROM (SELECT conv_id, turn, replace(coalesce(role, ''), '<|im_', '< |im_') AS role, replace(coalesce(text, ''), '<|im_', '< |im_') AS text
          FROM conversations)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turns
), reply AS (
    SELECT conv_id, max(pos) AS reply_at FROM placed WHERE role = 'assistant' GROUP BY conv_id
), replies AS (
    SELECT r.conv_id, r.reply_at, p.role, p.text,
           row_number() OVER (ORDER BY r.conv_id.id NULLS FIRST, r.conv_id.lone) AS place, count(*) OVER () AS total
    FROM reply r JOIN placed p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.pos = r.reply_at
), pairs AS (
    SELECT a.conv_id, b.conv_id AS other_id, a.reply_at, b.role, b.text
    FROM replies a JOIN replies b ON b.place = a.place % a.total + 1
), sides AS (
    SELECT q.conv_id, 'chosen' AS side, p.pos, p.role, p.text
    FROM pairs q JOIN placed p ON p.conv_id IS NOT DISTINCT FROM q.conv_id
    UNION ALL
    SELECT q.conv_id, 'rejected', p.pos, p.role, p.text
    FROM pairs q JOIN placed p ON p.conv_id IS NOT DISTINCT FROM q.conv_id AND p.pos < q.reply_at
    UNION ALL
    SELECT conv_id, 'rejected', reply_at, role, text FROM pairs
), met AS (
    SELECT conv_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
    FROM sides GROUP BY conv_id, pos
), shared AS (
    SELECT conv_id, coalesce(min(pos) FILTER (WHERE NOT same) - 1, max(pos)) AS n FROM met GROUP BY conv_id
), drawn AS (
    SELECT s.*, h.n, '<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10) AS shown
    FROM sides s JOIN shared h ON h.conv_id IS NOT DISTINCT FROM s.conv_id
), ends AS (
    SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id, side ORDER BY pos) AS upto FROM drawn WHERE pos > n
), ready AS (
    SELECT conv_id, side, string_agg(shown, '' ORDER BY pos) AS body,
           string_agg((upto - length(text) - 11)::BIGINT || ':' || (upto - 1)::BIGINT, ',' ORDER BY pos)
               FILTER (WHERE role = 'assistant') AS mask
    FROM ends GROUP BY conv_id, side
), prompts AS (
    SELECT conv_id, string_agg(shown, '' ORDER BY pos) AS prompt FROM drawn WHERE side = 'chosen' AND pos <= n GROUP BY conv_id
)
SELECT q.conv_id.id AS conv_id, q.other_id.id AS other_id, h.n::INTEGER AS n_prompt_turns, coalesce(p.prompt, '') AS prompt,
       coalesce(c.body, '') AS chosen, coalesce(r.body, '') AS rejected,
       coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM pairs q
JOIN shared h ON h.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN prompts p ON p.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN ready c ON c.conv_id IS NOT DISTINCT FROM q.conv_id AND c.side = 'chosen'
LEFT JOIN ready r ON r.conv_id IS NOT DISTINCT FROM q.conv_id AND r.side = 'rejected'
""",
    "op5_perfect_hash_dedup": r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), ranked AS (
    SELECT *,
           first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM ranked
""",
    "op12_box_tree_negatives": """
WITH rows AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           list_inner_product(a.vec, b.vec)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p
    JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""",
}
