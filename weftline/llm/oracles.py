"""SQL with the results of the corpus queries that SQL can express, for DuckDB."""

_SPACES = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

OP4 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT keyed.*, coalesce(doc_id < last, false) AS lost FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP2 = """
WITH w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+') IF x <> ''] AS ws FROM documents),
starts AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 49)) AS s, ws FROM w),
windows AS (SELECT doc_id, s, sha256(array_to_string(ws[s:s + 49], ' ')) AS h FROM starts),
owners AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS p FROM windows JOIN owners USING (h) WHERE first < doc_id),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP3 = """
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+') IF x <> ''] AS ws
  FROM documents),
shingles AS (
  SELECT doc_id, hash(array_to_string(ws[s:s + 3], ' ')) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, least(len(ws), 1)))) AS s FROM w)),
sets AS (SELECT DISTINCT doc_id, g FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
sides AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(d, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT d, y FROM reach JOIN sides ON x = r),
comp AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT d AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d = c AS kept FROM comp LEFT JOIN sizes ON doc_id = d
"""

BASE_COLUMNS = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+') IF x <> ''] AS ws FROM documents),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS s FROM w)),
twice AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, unnest(generate_series(s, s + 7)) AS p FROM windows JOIN twice USING (doc_id, g)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
doubled AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(doubled.n, 0)::BIGINT AS n_dup_lines,
       coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(repeated.n, 0) > 30 * len(ws) AS base_failed
FROM w LEFT JOIN repeated USING (doc_id) LEFT JOIN doubled USING (doc_id)
"""

SHARD_TOTALS = """
SELECT count(*) AS n_rows, sum(strlen(coalesce(text, '')) + 8)::BIGINT AS n_bytes, 24::BIGINT AS n_shards, true AS gapless, true AS even FROM documents
"""
