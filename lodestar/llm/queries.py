"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bpe, chat, katz, media, neighbours, pack, pii, simhash, substring, toxicity


def _chat_sql() -> str:
    """Turns and targets straight from the table, and the length of what the windows hold from their definition."""
    shown = "{}"
    for raw, code in chat.ESCAPES:
        shown = f"replace({shown}, '{raw}', '{code}')"
    role = f"replace({shown.format('role')}, chr(10), '{chat.NEWLINE[1]}')"
    length = f"length({role}) + length({shown.format('text')}) + {len(chat.BEGIN) + 1 + len(chat.END)}"
    return f"""
WITH source AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS idx,
  (length(text) + {chat.CHARS_PER_TOKEN - 1}) // {chat.CHARS_PER_TOKEN} + {chat.TURN_TOKENS} AS tokens, {length} AS shown FROM source),
sys AS (SELECT conv_id, MIN(idx) AS s_idx FROM turns WHERE role = 'system' GROUP BY 1),
known AS (SELECT t.*, s_idx, s.tokens AS s_tokens, s.shown AS s_shown, ({chat.BUDGET} - LEAST(COALESCE(s.tokens, 0), {chat.BUDGET // 2}) + 1) // 2 AS half,
  SUM(t.tokens) OVER (PARTITION BY t.conv_id ORDER BY t.idx) AS total
  FROM turns t LEFT JOIN sys USING (conv_id) LEFT JOIN turns s ON s.conv_id = t.conv_id AND s.idx = s_idx),
marked AS (SELECT *, CASE WHEN idx = 1 OR tokens > half OR LAG(tokens) OVER o > half OR ceil(total / half) > ceil(LAG(total) OVER o / half) THEN 1 ELSE 0 END AS fresh
  FROM known WINDOW o AS (PARTITION BY conv_id ORDER BY idx)),
placed AS (SELECT *, SUM(fresh) OVER (PARTITION BY conv_id ORDER BY idx) AS w FROM marked),
spans AS (SELECT conv_id, w, MIN(idx) AS first, SUM(tokens) AS own, ANY_VALUE(s_idx) AS s_idx, ANY_VALUE(s_tokens) AS s_tokens, ANY_VALUE(s_shown) AS s_shown FROM placed GROUP BY 1, 2),
told AS (SELECT *, COALESCE(s_idx < first AND (s_tokens + own <= {chat.BUDGET} OR own > {chat.BUDGET}), false) AS told FROM spans),
room AS (SELECT *, LEAST({chat.HISTORY_TOKENS}, {chat.BUDGET} - own - CASE WHEN told THEN s_tokens ELSE 0 END) AS spare FROM told),
near AS (SELECT r.conv_id, r.w, r.spare, p.shown, SUM(p.tokens) OVER (PARTITION BY r.conv_id, r.w ORDER BY p.idx DESC) AS run
  FROM room r JOIN turns p ON p.conv_id = r.conv_id AND p.idx < r.first AND p.idx >= r.first - {chat.HISTORY} AND NOT (r.told AND p.idx = r.s_idx)),
again AS (SELECT conv_id, SUM(shown) AS shown FROM (SELECT conv_id, shown FROM near WHERE run <= spare UNION ALL SELECT conv_id, s_shown FROM told WHERE told) GROUP BY 1),
whole AS (SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  COALESCE(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '') AS loss, SUM(shown) AS shown FROM turns GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(whole.shown + COALESCE(again.shown, 0) AS BIGINT) AS formatted_chars
FROM whole LEFT JOIN again USING (conv_id)"""


QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op3_personal_data": pii.op3_personal_data,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_best_fit_packing": pack.op6_best_fit_packing,
    "op7_nearest_neighbours": neighbours.op7_nearest_neighbours,
    "op8_chat_windows": chat.op8_chat_windows,
    "op9_katz_scores": katz.op9_katz_scores,
    "op10_media_columns": media.op10_media_columns,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS w FROM texts, LATERAL (SELECT UNNEST(range(1, len(words) - 18)) AS s)),
again AS (SELECT doc_id, s FROM windows QUALIFY ROW_NUMBER() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
covered AS (SELECT DISTINCT doc_id, UNNEST(range(s, s + 20)) AS i FROM again),
each AS (SELECT doc_id, i, words[i] AS word FROM texts, LATERAL (SELECT UNNEST(range(1, len(words) + 1)) AS i)),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM each e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY 1),
gone AS (SELECT doc_id, COUNT(*) AS n FROM covered GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    "op8_chat_windows": _chat_sql(),
}
