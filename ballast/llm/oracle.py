"""DuckDB statements for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

_OP2 = r"""
WITH t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t1 AS (
  SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 4 AS tokens,
         12 + 8 + 7 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS piece FROM t0),
t2 AS (
  SELECT *, row_number() OVER w AS place, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - tokens AS pos
  FROM t1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
system AS (SELECT conv_id, place AS sys, tokens AS sys_tokens, piece AS sys_piece FROM t2 WHERE role = 'system' QUALIFY place = min(place) OVER (PARTITION BY conv_id)),
t3 AS (SELECT t.*, sys, sys_tokens, greatest(1, 1024 - 256 - coalesce(sys_tokens, 0)) AS room FROM t2 t LEFT JOIN system s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
longest AS (SELECT conv_id, coalesce(max(tokens) FILTER (2 * tokens <= room), 0) AS longest FROM t3 GROUP BY conv_id),
-- a turn's window: the turns that begin in its cell and have as many long ones before them, the long ones apart
t4 AS (
  SELECT t.*, dense_rank() OVER (PARTITION BY t.conv_id ORDER BY pos // (room - longest), longs, long) AS win
  FROM (SELECT *, 2 * tokens > room AS long, count(*) FILTER (2 * tokens > room) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longs FROM t3) t
  JOIN longest l ON t.conv_id IS NOT DISTINCT FROM l.conv_id),
wins AS (
  SELECT conv_id, win, min(pos) AS start, min(place) AS begin, coalesce(min(sys) < min(place), false) AS later,
         greatest(0, least(256, 1024 - sum(tokens) - CASE WHEN min(sys) < min(place) THEN min(sys_tokens) ELSE 0 END)) AS back FROM t4 GROUP BY conv_id, win),
shown AS (
  SELECT conv_id, piece FROM t4
  UNION ALL SELECT conv_id, 10 FROM wins
  UNION ALL SELECT w.conv_id, sys_piece FROM wins w JOIN system s ON w.conv_id IS NOT DISTINCT FROM s.conv_id WHERE later
  UNION ALL SELECT t.conv_id, t.piece FROM t4 t JOIN wins w ON w.conv_id IS NOT DISTINCT FROM t.conv_id WHERE t.place < w.begin AND w.start - t.pos <= w.back AND t.place IS DISTINCT FROM t.sys),
chars AS (SELECT conv_id, sum(piece) AS formatted_chars FROM shown GROUP BY conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns, coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss FROM t4 GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM said JOIN chars USING (conv_id)
"""

_OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT i.a, i.b FROM inter i JOIN sizes x ON x.doc_id = i.a JOIN sizes y ON y.doc_id = i.b WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)),
reach AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.to_id),
least AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""

_OP7 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM repeats CROSS JOIN range(0, 50) t(k)),
words AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


_OP11 = f"""
WITH urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN list_has_any(string_split_regex(host, '[.-]'), ['adult','ads','bets','betting','casino','gambling','pills','poker','porn','spam','viagra','xxx']) THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT u.*, (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS rule,
             (SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS said FROM urls u)
"""

_OP13 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b, (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT AS c,
         regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(doc_id > least, false)::INT AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM docs LEFT JOIN said USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders120 AS (
  SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM letters l1 JOIN letters l2 ON l2.x <> l1.x JOIN letters l3 ON l3.x NOT IN (l1.x, l2.x) JOIN letters l4 ON l4.x NOT IN (l1.x, l2.x, l3.x)
  JOIN letters l5 ON l5.x NOT IN (l1.x, l2.x, l3.x, l4.x)),
counted AS (SELECT part, a, b, c, d, e, good, toxic, a + b + c + d + e AS fails, count(*) AS n FROM flags GROUP BY ALL),
-- how many of the filters up to a step, and at it, a document fails
met AS (
  SELECT *, CASE substr(filter_order, k, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS bad FROM counted CROSS JOIN orders120 CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
before AS (SELECT *, coalesce(sum(bad) OVER (PARTITION BY part, a, b, c, d, e, good, toxic, filter_order ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM met),
steps AS (
  SELECT part, filter_order, k, coalesce(sum(n) FILTER (sofar + bad = 0), 0) AS kept, coalesce(sum(n) FILTER (sofar = 0 AND bad = 1), 0) AS removed, coalesce(sum(n) FILTER (sofar > 0 AND bad = 1), 0) AS redundant,
         coalesce(sum(n) FILTER (bad = 1 AND fails = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (sofar = 0 AND bad = 1 AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (sofar = 0 AND bad = 1 AND toxic = 1), 0) AS toxic_lost
  FROM before GROUP BY ALL)
SELECT part, filter_order, k::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, substr(filter_order, k, 1)))::BIGINT AS shapley FROM steps
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_sorted_digest_array": _OP11, "op13_filter_interaction_audit": _OP13, "op2_budgeted_windows": _OP2, "op4_circulant_minhash": _OP4, "op7_repeated_phrase_automata": _OP7}
