"""DuckDB equivalents of the corpus queries, where SQL can express them. Numbers are written out here."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# Near-duplicates by their definition: an inverted index of shingles, exact overlaps, components by recursion.
ORACLES["op1_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') || '|' || CAST(least(len(w), 5) AS VARCHAR) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""

_STOPS = (
    "the of and to in is that it for was on with as by at be this from are or an a "
    "le la les des de du et en un une que est pour dans qui sur par au pas ne "
    "der die das und den von zu mit sich auf ist im nicht ein eine als auch dem für "
    "el los del se las por con una su para es no lo y"
).split()

ORACLES["op3_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), a AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_BLANK}, '')) > 0) AS l,
    string_split({_LOWER.format("translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '.,;:!?()' || chr(34) || chr(39), '     ')")}, ' ') AS p
  FROM t
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) > 2)
), h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), q AS (
  SELECT a.doc_id, len(w) AS n_words, length(translate(t, {_BLANK}, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(list_filter(p, lambda x: x IN ({", ".join(f"'{s}'" for s in _STOPS)}))) AS n_stop,
    length(t) - length(translate(t, '!', '')) AS n_shout,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_dots,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets
  FROM a LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 1.5 * n_words AND word_chars <= 14 * n_words AND n_symbols <= 0.25 * n_words
  AND n_stop >= 0.02 * n_words AND n_shout <= 0.3 * n_words AND n_dots <= 0.5 * n_lines AND n_bullets <= 0.9 * n_lines
  AND n_dup_lines <= 0.5 * n_lines AS kept
FROM b
"""

ORACLES["op6_decontaminate"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM i WHERE len(w) > 0)
), o AS (
  SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), f AS (SELECT o.doc_id, o.k, o.m, p.item_id FROM o JOIN p ON o.m = p.m AND o.g = p.g
), h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM f) GROUP BY doc_id
), z AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(z.n, 0) AS n_items, sha256(coalesce(z.s, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN z USING (doc_id)
"""

ORACLES["op8_line_dedup"] = f"""
WITH l AS (
  SELECT doc_id, p, s[p] AS line, {_LOWER.format(f"trim(s[p], {_BLANK})")} AS k
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY p), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""
