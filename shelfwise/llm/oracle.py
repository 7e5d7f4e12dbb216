"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

from shelfwise.llm.quality_rules import STOP_WORDS

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP2 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), levels AS (
  -- For every source: what is left and who shares it if all sources with a lower ratio are at their caps.
  SELECT a.source, a.words, a.weight,
         (SELECT CAST(3 * sum(words) AS BIGINT) FROM per_source)
           - 4 * CAST(coalesce(sum(b.words) FILTER (b.words * a.weight < a.words * b.weight), 0) AS BIGINT) AS rest,
         CAST(sum(b.weight) FILTER (b.words * a.weight >= a.words * b.weight) AS BIGINT) AS open
  FROM per_source a CROSS JOIN per_source b GROUP BY a.source, a.words, a.weight
), marked AS (
  SELECT *, 4 * words * open <= rest * weight AS capped FROM levels
), level AS (
  SELECT rest, open FROM marked WHERE NOT capped ORDER BY words / weight LIMIT 1
), targets AS (
  SELECT source, words,
         CASE WHEN capped THEN CAST(2 * words AS DOUBLE)
              ELSE weight * (SELECT rest FROM level) / (2 * (SELECT open FROM level)) END AS target
  FROM marked
), rates AS (
  SELECT s.doc_id, s.size, t.words, t.target,
         CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0.0 END AS rate,
         CAST('0x' || substr(sha256('mix-1:' || CAST(s.doc_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target,
       CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rates
"""

OP4 = f"""
WITH lines AS (
  SELECT doc_id, line, place, translate(trim(line, {_SPACE}), {_FOLD}) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.*, f.key IS NULL OR l.doc_id = f.keeper AS stays FROM lines l LEFT JOIN frequent f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP5 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), {_WORD}) AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS shingle
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT r.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP6 = f"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times
  FROM (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS win
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM words))
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(5) r(k) WHERE times > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS distinct_n, sum(length(line)) AS chars, sum(length(line)) FILTER (nth > 1) AS dup_chars
  FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)) WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n - l.distinct_n, 0) AS BIGINT) AS n_dup_lines, coalesce(l.chars, 0) AS line_chars, coalesce(l.dup_chars, 0) AS dup_chars,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^!]', '', 'g')) AS exclamations,
         len([x FOR x IN w IF x IN ({_STOPS})]) AS stops
  FROM words w LEFT JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN repeats r ON r.doc_id = w.doc_id
), based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.10
         AND capitals / word_chars <= 0.40 AND exclamations / n_words <= 0.25
         AND (n_words < 50 OR stops / n_words >= 0.02) AND (line_chars = 0 OR dup_chars / line_chars <= 0.30) AS kept
FROM based
"""

_QUOTE = r"\### Assistant: </turn> ok"
OP10 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_QUOTE}'), (-7, 1, 'assistant', '{_QUOTE}')
), placed AS (
  SELECT *, lag(role) OVER o IS NOT DISTINCT FROM role AS goes_on, lead(role) OVER o IS NOT DISTINCT FROM role AS more,
         length(text) + 4 * (length(text) - length(replace(text, '&', '')))
           + 3 * (2 * length(text) - length(replace(text, '<', '')) - length(replace(text, '>', ''))) AS chars
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(chars + CASE WHEN goes_on THEN 6 ELSE 7 + length(role) END + CASE WHEN more THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

OP11 = f"""
WITH RECURSIVE damaged AS (
  SELECT *, list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')],
    lambda crc, x: list_reduce([xor(crc, x)] || [0::BIGINT FOR i IN range(8)], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations)
), chosen AS (
  SELECT *, xor(crc, 4294967295) % 20 AS k FROM damaged
), kept AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS again
  FROM chosen WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER o AS place, lag(role[1]) OVER o || role[1] AS pair, trim(text, {_SPACE}) AS bare
  FROM kept WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))
), rows AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN place > min(place) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
), moves(state, initial, reached) AS (
  VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')
), missing(state, reached, role) AS (
  VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')
), inserted AS (
  -- What any number of insertions makes of a state, up to three: more lead back to a state that fewer reach.
  SELECT state, state AS reached, 0 AS cost, '' AS edits, '' AS made FROM missing
  UNION ALL SELECT state, reached, 3, 'I', chr(10) || role || ':' FROM missing
  UNION ALL SELECT a.state, b.reached, 6, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':' FROM missing a JOIN missing b ON b.state = a.reached
), edits AS (
  SELECT conv_id, place, state, state AS reached, 4 AS cost, 'D' AS edit, '' AS made FROM rows, missing
  UNION ALL SELECT conv_id, place, state, reached, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text
    FROM rows JOIN moves ON initial = role[1] WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, place, state, reached, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', chr(10) || m.role || ':' || text
    FROM rows, missing m WHERE fault IN ('', 'truncated')
), options AS (
  SELECT e.conv_id, e.place, i.state, e.reached, i.cost + e.cost AS cost, i.edits || e.edit AS edits, i.made || e.made AS made
  FROM inserted i JOIN edits e ON e.state = i.reached
), paths(conv_id, place, state, best) AS (
  SELECT conv_id, 0::BIGINT, '', struct_pack(cost := 0::BIGINT, audit := '', made := '') FROM counted
  UNION ALL
  SELECT p.conv_id, o.place, o.reached, min(struct_pack(cost := p.best.cost + o.cost, audit := p.best.audit || o.edits, made := p.best.made || o.made))
  FROM paths p JOIN options o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.place = p.place + 1 AND o.state = p.state
  GROUP BY p.conv_id, o.place, o.reached
), ended AS (
  SELECT p.conv_id, min(struct_pack(cost := best.cost + i.cost, audit := best.audit || i.edits, made := best.made || i.made)) AS best
  FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.place JOIN inserted i ON i.state = p.state
  WHERE i.reached IN ('', 'a') GROUP BY p.conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(substr(best.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

OP12 = f"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), failing AS (
  SELECT doc_id, part, (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b,
         (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT AS c, regexp_matches(text, '[#$%&*|]')::INT AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS e
  FROM words
), known AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masks AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n,
         count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM failing f LEFT JOIN known k ON k.doc_id = f.doc_id GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
         list_sum([0] || [1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step)])::INT AS earlier
  FROM orders, range(1, 6) s(step)
), counted AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (mask & (own | earlier) = 0) AS kept, sum(n) FILTER (mask & own > 0 AND mask & earlier = 0) AS removed,
         sum(n) FILTER (mask & own > 0 AND mask & earlier > 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
         sum(good) FILTER (mask & own > 0 AND mask & earlier = 0) AS good_lost, sum(toxic) FILTER (mask & own > 0 AND mask & earlier = 0) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""

ORACLE_SQL = {
    "op2_mixing": OP2,
    "op4_line_dedup": OP4,
    "op5_ngram_join": OP5,
    "op6_quality_rules": OP6,
    "op10_chat": OP10,
    "op11_structure_repair": OP11,
    "op12_filter_audit": OP12,
}
