"""The queries that SQL can express, in SQL for DuckDB."""

from __future__ import annotations

from clientela.llm.decontamination import TOKEN, UNITS
from clientela.llm.quality_rules import LEVELS

WORDS = r"[^\x20\x09-\x0D]+"


def crc32(column: str) -> str:
    """CRC-32 of a column's decimal text, bit by bit."""
    step = "CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END"
    byte = f"list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda h, _: {step}, xor(a, b))"
    codes = f"list_transform(string_split(({column})::VARCHAR, ''), lambda c: unicode(c)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, b: {byte}, 4294967295::BIGINT), 4294967295)"


_SHARE = "least({0} // greatest({1}, 1), 1000)"
OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS stratum
  FROM documents WHERE doc_id IS NOT NULL
), w AS (
  SELECT *, regexp_extract_all(t, '{WORDS}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l
  FROM d
), tri AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri), (SELECT unnest([0, 1, 2]) AS k)
  WHERE c > 1 GROUP BY r
), f AS (
  SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_capitals,
    length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [{_SHARE.format("1000 * n_symbols", "word_chars")}, {_SHARE.format("1000 * n_capitals", "word_chars")},
     {_SHARE.format("1000 * n_marks", "word_chars")}, {_SHARE.format("1000 * n_dup_lines", "n_lines")},
     {_SHARE.format("1000 * n_repeat_words", "n_words")}, {_SHARE.format("10 * word_chars", "n_words")},
     1000 - {_SHARE.format("10 * word_chars", "n_words")}] AS metrics
  FROM f
), known AS (
  SELECT m.doc_id, m.stratum, m.metrics, q.quality, {crc32("m.doc_id")} % 2 = 1 AS holdout
  FROM m JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)) q USING (doc_id)
  WHERE NOT base_failed
), fit AS (
  SELECT stratum, quality, unnest(range(1, 8)) AS metric, unnest(metrics) AS value FROM known WHERE NOT holdout
), cuts AS (
  SELECT DISTINCT stratum, metric, value - 1 AS cutoff FROM fit
), tails AS (
  SELECT c.stratum, c.metric, c.cutoff,
    count(*) FILTER (value > cutoff AND quality = 1) AS good, count(*) FILTER (value > cutoff AND quality = 0) AS bad,
    count(*) FILTER (quality = 1) AS all_good
  FROM cuts c JOIN fit USING (stratum, metric) GROUP BY ALL
), levels AS (
  SELECT unnest({list(range(len(LEVELS)))}) AS level, unnest({list(LEVELS)}) AS per
), chosen AS (
  SELECT stratum, level, metric, min(cutoff) AS cutoff
  FROM tails, levels WHERE bad > good AND good * 100000 <= all_good * per GROUP BY ALL
), totals AS (
  SELECT stratum, count(*) AS n FROM known WHERE holdout AND quality = 1 GROUP BY ALL
), lost AS (
  SELECT c.stratum, c.level, count(DISTINCT k.doc_id) AS k
  FROM chosen c JOIN known k ON k.stratum = c.stratum AND holdout AND quality = 1 AND k.metrics[c.metric] > c.cutoff
  GROUP BY ALL
), tested AS (
  SELECT c.stratum, c.level, coalesce(k, 0) AS k, n
  FROM (SELECT DISTINCT stratum, level FROM chosen) c JOIN totals USING (stratum) LEFT JOIN lost USING (stratum, level)
), bound AS (
  SELECT stratum, level, k <= n * 0.02 AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02) + (n - j) * ln(0.98)))
    FROM (SELECT unnest(range(0, k + 1)) AS j)) <= 0.05 / (SELECT count(*) FROM totals) AS ok
  FROM tested
), best AS (
  SELECT stratum, max(level) AS level
  FROM (SELECT stratum, level, bool_and(ok) OVER (PARTITION BY stratum ORDER BY level) AS passed FROM bound)
  WHERE passed GROUP BY stratum
), used AS (
  SELECT stratum, metric, cutoff FROM chosen JOIN best USING (stratum, level)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (
    SELECT 1 FROM used u WHERE u.stratum = m.stratum AND m.metrics[u.metric] > u.cutoff) AS kept
FROM m
"""


_HOST = "translate(regexp_extract({0}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}, '://[^/?#]*([^?#]*)', 1)"
_ADDRESS = f"{_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || regexp_extract({{0}}, '://[^/?#]*[^?#]*([?][^#]*)', 1)"
# an attribute's value: in double quotes, in single ones, or bare
_ATTRIBUTE = r"""coalesce(nullif(regexp_extract(t, '(?is)[\s"'']{name}\s*=\s*"([^"]*)"', 1), ''),
    nullif(regexp_extract(t, '(?is)[\s"'']{name}\s*=\s*''([^'']*)''', 1), ''), regexp_extract(t, '(?is)[\s"'']{name}\s*=\s*([^\s"''>]+)', 1))"""
_POINT = "(CASE WHEN {0} = 0 OR {0} > 1114111 OR {0} BETWEEN 55296 AND 57343 THEN 65533 ELSE {0} END)::INTEGER"
_UNSEEN = "(?is)" + "|".join(rf"<{t}\b.*?(?:</{t}|\z)" for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"))
OP2 = rf"""
WITH RECURSIVE rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), p AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), q AS (
  SELECT *, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM p
), seen AS (
  SELECT url, host, path, regexp_replace(regexp_replace(html, '(?is)<!--.*?(?:-->|\z)', ' ', 'g'), '{_UNSEEN}', ' ', 'g') AS html
  FROM q WHERE regexp_matches(html, '(?i)canonical|refresh')
), tag AS (
  SELECT url, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b(?:[^<>"'']|"[^"]*"|''[^'']*'')*>')) AS t FROM seen
), said_by AS (
  SELECT url, host, path, {_ATTRIBUTE.format(name="rel")} AS rel, {_ATTRIBUTE.format(name="http-equiv")} AS equiv,
    {_ATTRIBUTE.format(name="href")} AS href, {_ATTRIBUTE.format(name="content")} AS content, lower(t[1:5]) = '<link' AS link
  FROM tag
), raw AS (
  SELECT url, host, path, href AS x FROM said_by WHERE link AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical')
  UNION ALL SELECT url, host, path, regexp_extract(content, '(?i)^[^;,]*[;,]\s*(?:url\s*=\s*)?["'']?([^"'']*)', 1)
  FROM said_by WHERE NOT link AND lower(trim(equiv)) = 'refresh'
), plain AS (
  SELECT url, host, CASE WHEN path = '' THEN '/' ELSE path END AS path, regexp_replace(array_to_string(list_transform(
    regexp_extract_all(x, '&#[xX][0-9a-fA-F]{{1,6}};?|&#[0-9]{{1,7}};?|&[a-zA-Z]+;|&|[^&]+'), lambda e:
      CASE WHEN regexp_matches(e, '^&#[xX]') THEN chr({_POINT.format("('0x' || regexp_extract(e, '[xX]([0-9a-fA-F]+)', 1))::BIGINT")})
        WHEN regexp_matches(e, '^&#[0-9]') THEN chr({_POINT.format("regexp_extract(e, '[0-9]+')::BIGINT")})
        WHEN lower(e) = '&amp;' THEN '&' WHEN lower(e) = '&lt;' THEN '<' WHEN lower(e) = '&gt;' THEN '>'
        WHEN lower(e) = '&quot;' THEN '"' WHEN lower(e) = '&apos;' THEN chr(39) ELSE e END), ''),
    '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS target
  FROM raw
), joined AS (
  SELECT url, target, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN target[1:2] = '//' THEN 'http:' || target WHEN target[1] = '/' THEN 'http://' || host || target
    WHEN target[1] = '?' THEN 'http://' || host || path || target WHEN target[1] = '#' THEN url
    ELSE 'http://' || host || regexp_replace(path, '[^/]*$', '') || target END AS other
  FROM plain WHERE target <> ''
), cut AS (
  SELECT url, target, other, regexp_extract(other, '^([^:]*://[^/?#]*)', 1) AS head, {_PATH.format("other")} AS way,
    regexp_extract(other, '^[^:]*://[^/?#]*[^?#]*(.*)$', 1) AS rest
  FROM joined WHERE other IS NOT NULL
), whole AS (
  SELECT url, CASE WHEN target[1] = '#' OR NOT regexp_matches(way, '/[.][.]?(/|$)') THEN other
    ELSE head || '/' || array_to_string(kept, '/') || CASE WHEN len(kept) > 0 AND parts[-1] IN ('.', '..') THEN '/' ELSE '' END || rest END AS other
  FROM (
    SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(parts, lambda x: [x])), lambda a, b:
      CASE WHEN b[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END) AS kept
    FROM (SELECT *, string_split(substr(way, 2), '/') AS parts FROM cut))
), ends AS (
  SELECT {_ADDRESS.format("url")} AS u, {_ADDRESS.format("other")} AS v, url, other FROM whole WHERE {_HOST.format("url")} <> ''
), both_ways AS (
  SELECT u, v FROM ends UNION SELECT v, u FROM ends
), reach AS (
  SELECT u, u AS v FROM both_ways UNION SELECT reach.u, b.v FROM reach JOIN both_ways b ON reach.v = b.u
), named AS (
  SELECT u AS node, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM ends
  UNION SELECT v, {_HOST.format("other")}, {_PATH.format("other")} FROM ends
), fits AS (
  SELECT n.host, n.path, arg_max(r.host || r.path, (length(r.host || r.path), verdict = 'allow', r.host || r.path)) AS rule,
    arg_max(verdict, (length(r.host || r.path), verdict = 'allow', r.host || r.path)) AS verdict
  FROM (SELECT host, path FROM q UNION SELECT host, path FROM named) n
  JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY ALL
), said AS (
  SELECT node, verdict FROM named JOIN fits USING (host, path)
), alias AS (
  SELECT u AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict
  FROM reach JOIN said ON reach.v = said.node GROUP BY u
)
SELECT page_id, q.host, q.path, f.rule, coalesce(f.verdict, a.verdict, 'allow') AS verdict,
  CASE WHEN f.rule IS NOT NULL THEN 'rule' WHEN a.verdict IS NOT NULL THEN 'alias' ELSE 'none' END AS reason
FROM q LEFT JOIN fits f USING (host, path) LEFT JOIN alias a ON q.host <> '' AND a.node = {_ADDRESS.format("url")}
"""

_TEMPLATE = f"""list_transform(t, lambda x, i: CASE WHEN regexp_matches(x, '^\\p{{N}}') THEN '0' WHEN regexp_matches(x, '^\\p{{Lu}}') THEN '2'
    WHEN x IN {tuple(UNITS)} AND i > 1 AND coalesce(regexp_matches(t[i - 1], '^\\p{{N}}'), false) THEN '1' ELSE x END)"""
OP10 = rf"""
WITH i AS (
  SELECT item_id, t, least(len(t), 8) AS w, {_TEMPLATE} AS k
  FROM (SELECT DISTINCT item_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS t FROM benchmark WHERE item_id IS NOT NULL)
  WHERE len(t) > 0
), iw AS (
  SELECT item_id, w, p, k[p + 1:p + w] AS g FROM (SELECT *, unnest(range(0, len(k) - w + 1)) AS p FROM i)
  WHERE 2 * len(list_filter(k[p + 1:p + w], lambda x: x NOT IN ('0', '1', '2'))) >= w
), total AS (
  SELECT item_id, count(DISTINCT p) AS item_windows FROM iw GROUP BY ALL
), d AS (
  SELECT doc_id, t, {_TEMPLATE} AS k
  FROM (SELECT DISTINCT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS t FROM documents WHERE doc_id IS NOT NULL)
), dw AS (
  SELECT doc_id, w, a, k[a + 1:a + w] AS g
  FROM (SELECT *, unnest(range(0, len(k) - w + 1)) AS a FROM d, (SELECT DISTINCT w FROM iw))
), hit AS (
  SELECT DISTINCT doc_id, item_id, a, p, iw.w, a - p AS shift FROM dw JOIN iw ON dw.w = iw.w AND dw.g = iw.g
), likely AS (
  SELECT doc_id, item_id FROM hit JOIN total USING (item_id) GROUP BY doc_id, item_id, item_windows
  HAVING count(DISTINCT p) >= 0.6 * item_windows
), slot AS (
  SELECT doc_id, item_id, shift, i.t[p + n] AS item_value, d.t[a + n] AS doc_value
  FROM (SELECT *, unnest(range(1, w + 1)) AS n FROM hit SEMI JOIN likely USING (doc_id, item_id)) h
  JOIN d USING (doc_id) JOIN i USING (item_id)
  WHERE regexp_matches(i.t[p + n], '^[\p{{N}}\p{{Lu}}]')
), filled AS (
  SELECT doc_id, item_id, shift, count(*) AS slots, count(*) FILTER (c = 1) AS agreeing
  FROM (SELECT doc_id, item_id, shift, item_value, count(DISTINCT doc_value) AS c FROM slot GROUP BY ALL) GROUP BY ALL
)
SELECT doc_id, item_id, count(DISTINCT p) AS matched, item_windows, coalesce(max(slots), 0) AS slots, coalesce(max(agreeing), 0) AS agreeing
FROM hit SEMI JOIN likely USING (doc_id, item_id) LEFT JOIN filled USING (doc_id, item_id, shift) JOIN total USING (item_id)
WHERE coalesce(agreeing >= 0.8 * slots, true)
GROUP BY doc_id, item_id, item_windows HAVING count(DISTINCT p) >= 0.6 * item_windows
"""
OP11 = rf"""
WITH lab AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL
), w AS (
  SELECT *, regexp_extract_all(t, '{WORDS}') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), f AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), doc_id > first_id] AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN lab USING (doc_id)
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL
), l AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS x
), o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS p FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT part, p, x AS step, p[x] AS letter, n, n_good, n_toxic, fails[p[x]] AS fails_here,
    len(list_filter(p[1:x - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda i: i)) AS n_fails
  FROM g, o, l
), r AS (
  SELECT part, p, step, letter,
    coalesce(sum(n) FILTER (NOT fails_here AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails_here AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails_here AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails_here AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (fails_here AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (fails_here AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, array_to_string(list_transform(p, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INTEGER AS step,
  kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM r
"""


def _vectors(label: str) -> str:
    """Rows that take part, with their vectors of whole numbers."""
    return f"""
v AS (
  SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""


OP12 = f"""
WITH {_vectors("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")}, scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label IS NOT NULL AND b.label IS NOT NULL
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM scored JOIN positive USING (anchor_id)
WHERE label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
OP13 = f"""
WITH {_vectors("label")}, scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
ORACLE: dict[str, str] = {
    "op2_url_filters": OP2,
    "op3_quality_rules": OP3,
    "op10_benchmark_decontamination": OP10,
    "op11_filter_audit": OP11,
    "op12_hard_negatives": OP12,
    "op13_exact_top_k": OP13,
}
