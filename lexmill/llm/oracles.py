"""DuckDB SQL for the queries that SQL can express."""

BLANK = r"[\x20\x09-\x0D]"

OP1 = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS rid FROM t),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS s FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
gap AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS g FROM dup),
rep AS (SELECT rid, sum(g) AS n FROM gap GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, coalesce('=' || source, 'null') AS host, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN rep ON w.rid = rep.rid),
r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [(n_words < 20)::INT, (100 * n_repeat_words > 30 * n_words)::INT] AS base,
    [(4 * n_symbols > n_words)::INT, (2 * n_upper > word_chars)::INT, (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::INT, (word_chars < 2 * n_words OR word_chars > 14 * n_words)::INT] AS other
  FROM f),
h AS (SELECT host, i AS rule, count(*) AS n, sum(list_concat(base, other)[i])::BIGINT AS x FROM r, (SELECT unnest(range(1, 7)) AS i) GROUP BY host, i),
p AS (SELECT rule, least(greatest(sum(x) / sum(n), 1e-6), 1 - 1e-6) AS mean, sum(x * x / n) AS sq, sum(n)::DOUBLE AS docs, count(*) - 1 AS sampling, sum(n::DOUBLE * n) / sum(n) AS weight FROM h GROUP BY rule),
e AS (SELECT *, CASE WHEN docs - weight - sampling > 1e-9 THEN ((sq - docs * mean * mean) / (mean * (1 - mean)) - sampling) / (docs - weight - sampling) ELSE 0 END AS share FROM p),
k AS (SELECT rule, mean, round(1 / least(greatest(share, 1 / 10001), 1 / 3) - 1, 6) AS strength FROM e),
hr AS (SELECT host, mean, n, strength, (x + mean * strength) / (n + strength) AS rate FROM h JOIN k USING (rule)),
hs AS (SELECT *, sqrt(rate * (1 - rate) / (n + strength + 1)) AS sd FROM hr),
v AS (SELECT host, max((rate - mean) / sd) AS excess, CASE WHEN bool_or(rate - 2 * sd > greatest(0.5, mean)) THEN 'rejected' WHEN max((rate - mean) / sd) > 2 THEN 'watched' ELSE 'trusted' END AS verdict FROM hs GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND list_sum(other) <= CASE verdict WHEN 'rejected' THEN -1 WHEN 'watched' THEN 0 ELSE 1 END AS kept,
  list_sum(other)::INT AS n_rules_failed, round(excess, 6) AS host_excess, verdict AS host_verdict
FROM r JOIN v USING (host)
"""

OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'text' || coalesce(text, ''))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY key),
o AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0)::BIGINT AS held, (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open, sum(source_size) OVER ()::BIGINT AS total, row_number() OVER by_cap AS place
  FROM s WINDOW by_cap AS (ORDER BY 2 * source_size / weight, key), before AS (ORDER BY 2 * source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total * 150 - 100 * held)::DOUBLE / (100 * open)::DOUBLE AS level FROM o WHERE weight * ((total * 150 - 100 * held)::DOUBLE / (100 * open)::DOUBLE) < 2 * source_size ORDER BY place LIMIT 1),
t AS (SELECT key, source_size, CASE WHEN (SELECT count(*) FROM l) = 0 THEN (2 * source_size)::DOUBLE ELSE least((2 * source_size)::DOUBLE, weight * (SELECT level FROM l)) END AS target FROM s),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (SELECT doc_id, size, source_size, target, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies FROM d JOIN r USING (key))
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""

OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, row_number() OVER () AS rid FROM documents),
b AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER best AS place, first_value(doc_id) OVER best AS keep_id
  FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST, rid DESC))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM b
"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS did, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, did, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(did) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT did) >= 3),
x AS (SELECT k.*, g.key IS NOT NULL AND k.did < g.last AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY rid, doc_id
"""

OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(er) + 1 + length(et) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP11 = r"""
WITH RECURSIVE d AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS did, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (did > min(did) OVER (PARTITION BY text))::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*)::BIGINT AS n, sum(good)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM m GROUP BY part, mask),
o AS (
  SELECT '' AS filter_order, 0 AS held UNION ALL
  SELECT filter_order || x, held | (1 << i) FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([0, 1, 2, 3, 4]) AS i) WHERE held & (1 << i) = 0),
s AS (
  SELECT filter_order, step, (1 << (ascii(substr(filter_order, step, 1)) - 65)) AS bit,
    list_sum([0] || list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k::INT, 1)) - 65)))::INT AS before
  FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE length(filter_order) = 5))
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step, bit, before
"""

OP12 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT row_number() OVER () AS pid, lang, words FROM (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM t) WHERE len(words) > 0),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, words[i:i + m - 1] AS w FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, m, array_to_string(w, ' ') AS phrase, count(*)::BIGINT AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
x AS (
  SELECT c.lang, c.m, c.phrase, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (SELECT lang, m - 1 AS m, f, unnest([array_to_string(string_split(phrase, ' ')[1:m - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase FROM f WHERE m > 2),
y AS (SELECT lang, phrase, max(f) AS most FROM e GROUP BY lang, phrase),
s AS (SELECT b.* FROM b LEFT JOIN y ON y.lang = b.lang AND y.phrase = b.phrase WHERE y.most IS NULL OR 100 * y.most::HUGEINT < 80 * a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM s JOIN n USING (lang) QUALIFY rank <= 2000
"""

OP13 = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, coalesce(vec_id, 9223372036854775807) AS did, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND coalesce(len(embedding), 0) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
u AS (SELECT rid, label, e, len(e) AS dim, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE ok),
p AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.label = b.label AND a.dim = b.dim AND a.rid <> b.rid WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT r.a AS rid, min(v.did) AS component FROM r JOIN v ON v.rid = r.b GROUP BY r.a),
n AS (SELECT a AS rid, count(*) AS n_links FROM p GROUP BY a)
SELECT nullif(did, 9223372036854775807) AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, nullif(component, 9223372036854775807) AS component_id, did = component AS kept
FROM v JOIN k USING (rid) LEFT JOIN n USING (rid)
"""

SQL = {"op11_filter_audit": OP11, "op12_phrases": OP12, "op13_embedding_dups": OP13, "op4_chat_format": OP4, "op1_quality_rules": OP1, "op3_mixing": OP3, "op5_exact_dedup": OP5, "op10_line_dedup": OP10}
