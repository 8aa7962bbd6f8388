"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS words FROM benchmark),
item_windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(words, k, k + n - 1), ' ') AS w
  FROM (SELECT item, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k FROM i WHERE len(words) > 0)),
doc_windows AS (SELECT doc_id, k, n, array_to_string(list_slice(words, k, k + n - 1), ' ') AS w
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM item_windows) l)),
met AS (SELECT doc_id, k, n, item FROM doc_windows JOIN item_windows USING (n, w)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM met) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (SELECT doc_id, k, md5(array_to_string(list_slice(words, k, k + 49), ' ')) AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS k FROM d WHERE len(words) >= 50)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM windows JOIN firsts USING (w) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN (
  SELECT w.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS kept FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY 1) k USING (doc_id)"""


def _rule(r) -> str:
    base = f" * {r.denominator}" if r.denominator else ""
    parts = ([f"{r.numerator} >= {r.least}e0{base}"] if r.least is not None else []) + ([f"{r.numerator} <= {r.most}e0{base}"] if r.most is not None else [])
    return " AND ".join(parts)


OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, k, array_to_string(list_slice(words, k, k + 7), ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS k FROM d WHERE len(words) > 8)),
twice AS (SELECT doc_id, w FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM windows JOIN twice USING (doc_id, w)) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}))) AS n_stop_words, len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
  coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN covered c USING (doc_id)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(_rule(r) for r in RULES)} AS kept FROM j"""

OP10 = f"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line, {_LOWER.format(f"trim(parts[i], {_BLANKS})")} AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), frequent AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key) GROUP BY doc_id"""

#: For pages whose article stands in the element of that name, as in the given tables: what its tags say, without any scores.
OP12 = r"""
WITH own AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS t FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(?:p|h1|br)(?:\s[^>]*)?/?>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM own),
decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM bare)
SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM decoded"""
