"""What SQL can say of the operators: the same rows, by plain queries over whole tables."""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WHITE = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"
_WORD = r"'[^\x20\x09-\x0D]+'"

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
p AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM d),
l AS (SELECT doc_id, i, a[i] AS line, translate(trim(a[i], {_WHITE}), {_LETTERS}) AS k FROM p),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
r AS (SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
  count(*) OVER (PARTITION BY s) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM r
"""

CHAT_FORMAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, 17 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
  + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS marked FROM c),
e AS (SELECT *, 3 + sum(marked) OVER w AS so_far,
  role = 'assistant' OR row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS ends
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(so_far) FILTER (WHERE ends) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id,
  regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), {_WORD}) AS a FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, CASE WHEN len(a) < 2 THEN array_to_string(a, ' ')
    ELSE concat(a[i], ' ', a[i + 1]) END AS x
  FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a), 2))) AS i FROM w WHERE len(a) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT l.doc_id AS i, r.doc_id AS j, count(*) AS shared FROM s l JOIN s r ON l.x = r.x
  WHERE l.doc_id <> r.doc_id GROUP BY 1, 2),
k AS (SELECT i, j FROM b JOIN n p ON p.doc_id = i JOIN n q ON q.doc_id = j
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
c(i, j) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.i, k.j FROM c JOIN k ON c.j = k.i)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.j AS component_id, d.doc_id = m.j AS kept
FROM documents d JOIN (SELECT i, min(j) AS j FROM c GROUP BY i) m ON m.i = d.doc_id
LEFT JOIN n ON n.doc_id = d.doc_id
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS a FROM documents),
g AS (SELECT doc_id, i, a[i:i + 7] AS x FROM (SELECT doc_id, a, unnest(range(1, len(a) - 6)) AS i FROM d)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, line, regexp_extract_all(translate(line, {_LETTERS}), {_WORD}) AS b
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE len(b) > 0 GROUP BY doc_id),
q AS (SELECT doc_id, source, t, array_to_string(b, ' ') AS k, len(b) AS words FROM l WHERE len(b) > 0),
o AS (SELECT source, k FROM q GROUP BY source, k HAVING count(DISTINCT t) > 20),
x AS (SELECT doc_id, sum(words) AS n FROM q JOIN o ON o.k = q.k AND o.source IS NOT DISTINCT FROM q.source GROUP BY doc_id),
f AS (SELECT d.doc_id, len(a) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (removed_words > 0 AND
    (n_words - removed_words < 20 OR n_words - removed_words < 0.30 * n_words)) AS kept FROM f
"""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE bits(b, n, v) AS (SELECT x::BIGINT, 0, x::BIGINT FROM range(256) t(x)
  UNION ALL SELECT b, n + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE n < 8),
tab AS (SELECT b, v FROM bits WHERE n = 8),
keys AS (SELECT DISTINCT concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
crc(k, i, v) AS (SELECT k, 0, 4294967295::BIGINT FROM keys
  UNION ALL SELECT k, i + 1, xor(crc.v >> 8, tab.v) FROM crc JOIN tab ON tab.b = xor(crc.v & 255, ascii(k[i + 1])) WHERE i < length(k)),
draw AS (SELECT k, xor(v, 4294967295) % 20 AS r FROM crc WHERE i = length(k)),
g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, r
  FROM conversations JOIN draw ON k = concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) WHERE r <> 0),
d AS (SELECT conv_id, turn, CASE r WHEN 4 THEN 'user' ELSE role END AS role,
  CASE r WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE r WHEN 3 THEN 2 ELSE 1 END)) AS again FROM g),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  rtrim(text, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))) AS t FROM d),
m AS (SELECT conv_id, turn, role, text, i, role[1] AS c, CASE WHEN t = '' THEN 'b'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'r'
  WHEN t[-1] NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS kind,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
f AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (WHERE kind = 'b') AS blank, count(*) FILTER (WHERE kind = 'r') AS duplicate,
  count(*) FILTER (WHERE kind = 't') AS truncated,
  count(*) FILTER (WHERE p IS NOT NULL AND concat(p, c) NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
-- before a turn that stays: j inserts in state e (0 nothing, 1 system, 2 user, 3 assistant), then this role
way AS (SELECT e, j, CASE WHEN ((e = 2)::INT + j) % 2 = 0 THEN 'user' ELSE 'assistant' END AS want,
  CASE WHEN j = 0 THEN [] WHEN e = 2 THEN ['assistant:', 'user:'][1:j] ELSE ['user:', 'assistant:'][1:j] END AS ins
  FROM range(4) a(e), range(3) b(j)),
w(conv_id, i, e, best) AS (SELECT conv_id, 0::BIGINT, 0::BIGINT, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} FROM f
  UNION ALL SELECT conv_id, i, e, min(best) FROM (
    SELECT w.conv_id, m.i, w.e, {'cost': best.cost + 4, 'audit': best.audit || 'D', 'said': best.said} AS best
    FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
    UNION ALL SELECT w.conv_id, m.i, 1, {'cost': best.cost + CASE kind WHEN 't' THEN 3 ELSE 0 END,
      'audit': best.audit || 'K', 'said': list_append(best.said, concat(role, ':', text))}
    FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
    WHERE w.e = 0 AND c = 's' AND kind IN ('k', 't')
    UNION ALL SELECT w.conv_id, m.i, CASE want WHEN 'user' THEN 2 ELSE 3 END,
      {'cost': best.cost + 3 * j + CASE kind WHEN 't' THEN 3 ELSE 0 END + CASE WHEN c = want[1] THEN 0 ELSE 3 END,
       'audit': concat(best.audit, repeat('I', j::INT), CASE WHEN c = want[1] THEN 'K' ELSE 'R' END),
       'said': list_append(list_concat(best.said, ins), concat(CASE WHEN c = want[1] THEN role ELSE want END, ':', text))}
    FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 JOIN way ON way.e = w.e
    WHERE kind IN ('k', 't')) GROUP BY conv_id, i, e),
z AS (SELECT w.conv_id, min(CASE w.e WHEN 1 THEN {'cost': best.cost + 6, 'audit': best.audit || 'II', 'said': list_concat(best.said, ['user:', 'assistant:'])}
  WHEN 2 THEN {'cost': best.cost + 3, 'audit': best.audit || 'I', 'said': list_append(best.said, 'assistant:')} ELSE best END) AS best
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""

RANKED_SEARCH = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LETTERS}),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_LETTERS}),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // total) AS m FROM d, c),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY term, doc_id),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""
