"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from crossweave.llm.license_scan import TEMPLATES, THRESHOLD, anchors

OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) > 1 AS again FROM grams),
covered AS (SELECT DISTINCT r, i + j AS p FROM counted, range(3) t(j) WHERE again),
repeats AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
base AS (
  SELECT d.r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE base_failed) AS n_failed FROM judged GROUP BY source),
moments AS (SELECT coalesce(avg(n_failed / n_docs), 0) AS m, var_pop(n_failed / n_docs) AS v, avg(1 / n_docs) AS a FROM hosts),
prior AS (SELECT m, 1 / least(greatest(CASE WHEN m * (1 - m) > 0 AND a < 1 THEN (v / (m * (1 - m)) - a) / (1 - a) ELSE 0.0 END, 1e-6), 1.0) - 1 AS s FROM moments),
verdicts AS (SELECT source, (n_failed + m * s) / (n_docs + s) <= 0.5 AS host_kept FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND host_kept AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""

_LICENCES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(TEMPLATES.items()))
_GRAMS = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
_WORDS = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"

_ANCHORS = ", ".join(f"('{name}', '{gram}', {before})" for name, gram, before in anchors(TEMPLATES, THRESHOLD))

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT DISTINCT r, part FROM (
    SELECT r, unnest(string_split(text, chr(10))) AS part FROM d
    UNION ALL SELECT r, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM d
    UNION ALL SELECT r, text FROM d)),
pw AS (SELECT r, part, {_WORDS.format("part")} AS w FROM parts),
pg AS (SELECT r, part, {_GRAMS} AS g FROM pw WHERE len(w) >= 2),
tw AS (SELECT name, {_WORDS.format("body")} AS w FROM (VALUES {_LICENCES}) t(name, body)),
tg AS (SELECT name, len(w) AS n_words, {_GRAMS} AS h FROM tw),
pe AS (SELECT r, part, len(g) AS a, unnest(g) AS gram FROM pg),
te AS (SELECT name, len(h) AS b, unnest(h) AS gram FROM tg),
common AS (SELECT r, part, name, any_value(a) AS a, any_value(b) AS b, count(*) AS c FROM pe JOIN te USING (gram) GROUP BY r, part, name),
found AS (SELECT r, part, name, 2.0::DOUBLE * c / (a + b) AS sim FROM common WHERE 2.0 * c / (a + b) >= 0.8 - 1e-9),
dw AS (SELECT r, {_WORDS.format("text")} AS w FROM d),
de AS (SELECT r, i - 1 AS i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM dw)),
hits AS (SELECT DISTINCT r, name, greatest(i - before, 0) AS s FROM de JOIN (VALUES {_ANCHORS}) a(name, gram, before) USING (gram)),
we AS (SELECT DISTINCT h.r, h.name, s, de.gram FROM hits h JOIN tg ON tg.name = h.name JOIN de ON de.r = h.r AND de.i >= s AND de.i < s + n_words - 1),
wa AS (SELECT r, name, s, count(*) AS a FROM we GROUP BY ALL),
wc AS (SELECT r, we.name, s, count(*) AS c, any_value(b) AS b FROM we JOIN te ON te.name = we.name AND te.gram = we.gram GROUP BY ALL),
wins AS (SELECT r, name, s, 2.0::DOUBLE * c / (a + b) AS sim FROM wa JOIN wc USING (r, name, s) WHERE 2.0 * c / (a + b) >= 0.8 - 1e-9),
every AS (SELECT r, name, sim FROM found UNION ALL SELECT r, name, sim FROM wins),
best AS (SELECT r, arg_min(name, (-sim, name)) AS license, round(max(sim), 6) AS similarity, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM every GROUP BY r)
SELECT doc_id, license, coalesce(similarity, 0.0)::DOUBLE AS similarity, licenses, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(n_windows, 0)::BIGINT AS n_windows
FROM d LEFT JOIN best USING (r) LEFT JOIN (SELECT r, count(DISTINCT part) AS n_matches FROM found GROUP BY r) USING (r) LEFT JOIN (SELECT r, count(*) AS n_windows FROM wins GROUP BY r) USING (r)
"""

OP4 = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
l AS (
  SELECT r, conv_id, turn, i, line, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(regexp_replace(line, '^((?:[ \t]*>)+)', ''), '[ \t\r]+', ' ', 'g')) AS bare
  FROM (SELECT r, conv_id, turn, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM m)),
lv AS (SELECT *, CASE WHEN bare = '' THEN -1 ELSE level END AS lev FROM l),
st AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM lev THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run
       FROM (SELECT *, lag(lev) OVER (PARTITION BY r ORDER BY i) AS before, lead(level) OVER (PARTITION BY r ORDER BY i) AS after FROM lv)),
p AS (
  SELECT r, any_value(conv_id) AS conv_id, any_value(turn) AS turn, min(i) AS place, any_value(lev) AS level, run, count(*) AS n, 0 AS part, lower(string_agg(bare, ' ' ORDER BY i)) AS t
  FROM st WHERE lev >= 0 GROUP BY r, run),
units AS (
  SELECT r, conv_id, turn, place, level, part, t FROM p
  UNION ALL SELECT st.r, st.conv_id, st.turn, i, lev, 1, lower(bare) FROM st JOIN p ON st.r = p.r AND st.run = p.run WHERE n > 1),
q AS (SELECT * FROM units WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
here AS (SELECT t, conv_id, min(turn) AS turn FROM units WHERE level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
first AS (SELECT t, min((conv_id, turn)) AS f FROM here WHERE length(t) >= 12 GROUP BY t),
linked AS (
  SELECT q.conv_id, q.turn, q.level, q.place, q.part, CASE WHEN here.turn < q.turn THEN (here.conv_id, here.turn) WHEN f < (q.conv_id, q.turn) THEN f END AS target
  FROM q LEFT JOIN here ON q.t = here.t AND q.conv_id = here.conv_id LEFT JOIN first ON q.t = first.t),
reply AS (SELECT conv_id, turn, arg_min(target, (level, place, part, target)) AS target FROM linked WHERE target IS NOT NULL GROUP BY conv_id, turn),
flat AS (SELECT conv_id, turn, target[1] AS to_conv, target[2] AS to_turn FROM reply),
walk AS (
  SELECT conv_id, turn, to_conv AS c, to_turn AS t, 1 AS depth FROM flat
  UNION ALL SELECT w.conv_id, w.turn, f.to_conv, f.to_turn, depth + 1 FROM walk w JOIN flat f ON w.c = f.conv_id AND w.t = f.turn),
root AS (SELECT conv_id, turn, arg_max(c, depth) AS c, arg_max(t, depth) AS t, max(depth) AS depth FROM walk GROUP BY ALL),
content AS (
  SELECT r, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i), ''), '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS content
  FROM st WHERE level = 0 AND NOT (regexp_matches(line, '^On .+ wrote:[ \t]*$') AND coalesce(after, 0) > 0) GROUP BY r),
quotes AS (SELECT r, count(*) AS n, max(level) AS most FROM p WHERE level > 0 GROUP BY r)
SELECT m.conv_id, m.turn, m.role, coalesce(content, '') AS content, coalesce(n, 0)::BIGINT AS n_quotes, coalesce(most, 0)::INTEGER AS max_level,
       to_conv AS reply_conv, to_turn AS reply_turn,
       CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN coalesce(root.c, m.conv_id) END AS thread_conv,
       CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN coalesce(root.t, m.turn) END AS thread_turn,
       coalesce(depth, 0)::INTEGER AS depth
FROM m LEFT JOIN content USING (r) LEFT JOIN quotes USING (r)
LEFT JOIN flat ON m.conv_id = flat.conv_id AND m.turn = flat.turn
LEFT JOIN root ON m.conv_id = root.conv_id AND m.turn = root.turn
"""

ORACLES = {
    "op2_license_scan": OP2,
    "op4_chat_formatting": OP4,
    "op10_quality_rules": OP10,
}
