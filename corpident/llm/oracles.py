"""SQL equivalents, for DuckDB, of the queries that SQL can express on whole tables."""

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
reps AS (SELECT doc_id, count(DISTINCT place) AS n FROM twice GROUP BY doc_id),
m AS (SELECT w.doc_id, t, ls, len(ws) AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  (len([x FOR x IN ls IF regexp_matches(x, '{WORD}')]) - len(list_distinct([x FOR x IN ls IF regexp_matches(x, '{WORD}')])))::BIGINT AS n_dup_lines,
  coalesce(reps.n, 0) AS n_repeat_words,
  len(regexp_extract_all(t, '\p{{L}}')) AS letters, len(regexp_extract_all(t, '(?:^|[\x20\x09-\x0D])\p{{Lu}}{{2,}}')) AS caps,
  len([x FOR x IN ls IF regexp_matches(x, '^[\x20\x09]*[-*•]')]) AS bullets, len([x FOR x IN ls IF regexp_matches(x, '(?:\.\.\.|…)[\x20\x09\x0D]*\z')]) AS dots
  FROM w LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * len(ls))
    OR 10 * letters < 6 * word_chars OR 10 * caps > 3 * n_words OR 10 * bullets > 9 * len(ls) OR 10 * dots > 3 * len(ls)) AS kept
FROM b"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_ADDED = "'<|im_end|><|im_start|>assistant ok'"

OP5 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_ADDED} UNION ALL SELECT -1, 1, 'assistant', {_ADDED}),
e AS (SELECT *, '<|im_start|>' || {_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, formatted)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source) AS k FROM s),
p AS (SELECT *, (SELECT sum(source_size) * 150 FROM s) - coalesce(sum(200 * source_size) OVER before, 0) AS rest, (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER before, 0) AS shares
  FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS k FROM p WHERE weight * rest < 200 * source_size * shares),
r AS (SELECT rest, shares, p.k FROM p, f WHERE p.k = f.k),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN (SELECT k FROM r) IS NULL OR k < (SELECT k FROM r) THEN source_size::DOUBLE * 2
  ELSE (weight * (SELECT rest FROM r))::DOUBLE / (100 * (SELECT shares FROM r))::DOUBLE END AS target FROM p),
n AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS n,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS e,
  CAST('0x' || substr(md5('0:' || coalesce(d.source, '')), 1, 5) AS BIGINT)::DOUBLE / 1048576.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * least(floor(n::DOUBLE * e + u) - floor((n - 1)::DOUBLE * e + u), ceil(e)))::BIGINT AS taken FROM n"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, strlen(html) AS n FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM q"""

ORACLE = {"op1_quality_rules": OP1, "op5_chat_format": OP5, "op6_mixing": OP6, "op7_warc": OP7}
