"""SQL for the operators that SQL can express."""

from __future__ import annotations

from souk.llm.quality import EDGES, Limits

_limits = Limits()
_word = r"[^\x20\x09-\x0D]+"
_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_marks = EDGES.replace("'", "''")
_class = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": " ", "line": r"[\n\r\t\x0B\x0C]", "mark": "[.,;:!?''\"()-]", "other": r"[^\x00-\x7F]"}
_counts = ", ".join(f"(length(t) - length(regexp_replace(t, '{p}', '', 'g')))::DOUBLE AS {c}" for c, p in _class.items())
_all = "lower + upper + digit + space + line + mark + other"


def _distance(p: str, q: str) -> str:
    return f"sqrt(greatest(0, (sum(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END) + sum(CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)) / 2))"


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, lang, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_word}') AS w,
    regexp_extract_all(translate(coalesce(text, ''), '{_upper}{_marks}', '{_lower}{" " * len(EDGES)}'), '{_word}') AS plain FROM documents),
trigrams AS (SELECT doc_id, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, k FROM trigrams GROUP BY 1, 2 HAVING count(*) > 1),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS place FROM trigrams JOIN twice USING (doc_id, k)) GROUP BY 1),
base AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_word}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_word}')))))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(plain) AS n_plain, length(t) AS n_chars FROM d LEFT JOIN repeats USING (doc_id)),
of_word AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(plain) AS word FROM d WHERE lang IS NOT NULL AND text IS NOT NULL) GROUP BY 1, 2),
of_lang AS (SELECT lang, sum(n) AS total FROM of_word GROUP BY 1),
refs AS (SELECT lang, total FROM of_lang WHERE total >= {_limits.least_reference_words}),
common AS (SELECT lang, word, n, total FROM of_word JOIN refs USING (lang) WHERE n * {_limits.common_share} >= total),
pairs AS (SELECT doc_id, r.lang FROM base b JOIN refs r ON r.lang = b.lang OR b.lang IS NULL),
of_doc AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(plain) AS word FROM d) GROUP BY 1, 2),
bins AS (SELECT p.doc_id, p.lang, coalesce(x.n, 0) AS n, c.n AS m, c.total FROM pairs p JOIN common c USING (lang) LEFT JOIN of_doc x ON x.doc_id = p.doc_id AND x.word = c.word),
all_bins AS (SELECT doc_id, lang, n / n_plain AS p, m / total AS q FROM bins JOIN (SELECT doc_id, n_plain FROM base WHERE n_plain > 0) USING (doc_id)
  UNION ALL SELECT p.doc_id, p.lang, (b.n_plain - coalesce(s.n, 0)) / b.n_plain, 1 - coalesce(s.m, 0) / r.total FROM pairs p JOIN base b USING (doc_id) JOIN refs r ON r.lang = p.lang
    LEFT JOIN (SELECT doc_id, lang, sum(n) AS n, sum(m) AS m FROM bins GROUP BY 1, 2) s ON s.doc_id = p.doc_id AND s.lang = p.lang WHERE b.n_plain > 0),
word_far AS (SELECT doc_id, min(x) AS word_distance FROM (SELECT doc_id, lang, {_distance("p", "q")} AS x FROM all_bins GROUP BY 1, 2) GROUP BY 1),
shapes AS (SELECT doc_id, lang, text IS NOT NULL AS given, length(t)::DOUBLE AS total, {_counts} FROM d),
full_shapes AS (SELECT *, total - ({_all}) AS symbol FROM shapes),
long_shapes AS (UNPIVOT (SELECT doc_id, lang, given, total, {", ".join(_class)}, symbol FROM full_shapes) ON {", ".join(_class)}, symbol INTO NAME kind VALUE n),
ref_shapes AS (SELECT lang, kind, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM long_shapes WHERE given AND lang IN (SELECT lang FROM refs) GROUP BY 1, 2),
char_far AS (SELECT doc_id, min(x) AS char_distance FROM (SELECT l.doc_id, p.lang, {_distance("(l.n / l.total)", "r.q")} AS x
  FROM long_shapes l JOIN pairs p USING (doc_id) JOIN ref_shapes r ON r.lang = p.lang AND r.kind = l.kind WHERE l.total > 0 GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {_limits.least_words} OR 100 * n_repeat_words > {_limits.most_repeated_percent} * n_words AS base_failed,
  NOT (n_words < {_limits.least_words} OR 100 * n_repeat_words > {_limits.most_repeated_percent} * n_words
    OR (n_chars >= {_limits.least_chars_judged} AND coalesce(char_distance, 0) > {_limits.most_char_distance})
    OR (n_plain >= {_limits.least_words_judged} AND coalesce(word_distance, 0) > {_limits.most_word_distance} + {_limits.word_distance_by_length} / sqrt(greatest(n_plain, 1)))) AS kept
FROM base LEFT JOIN word_far USING (doc_id) LEFT JOIN char_far USING (doc_id)
"""

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_word}') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) > 12)),
first AS (SELECT k, min(doc_id) AS doc FROM windows GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS place FROM windows JOIN first USING (k) WHERE doc_id > doc),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: base32 of a SHA-1, from its 40 hexadecimal digits: five of them are four characters.
_base32 = "list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (g * 5 + 1)::INTEGER, 5))::BIGINT >> b) & 31)::INTEGER + 1, 1)), 'string_agg', '')), 'string_agg', '')"

OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_base32} AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""

#: Similar pairs by all shared shingles, and what links connect. Texts without words are linked to equal ones only.
OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(text, '{_word}') AS w FROM documents WHERE text IS NOT NULL),
shingles AS (SELECT doc_id, array_to_string(w[s : s + least(len(w), 5) - 1], ' ') AS k, least(len(w), 5) AS size
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
sets AS (SELECT doc_id, k, size, count(*) AS n FROM shingles GROUP BY ALL),
totals AS (SELECT doc_id, sum(n) AS total FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS n FROM sets a JOIN sets b ON a.k = b.k AND a.size = b.size AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN totals a ON a.doc_id = x JOIN totals b ON b.doc_id = y WHERE 5 * n >= 4 * (a.total + b.total - n)
  UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.text = b.text),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON r.other = l.x)
SELECT doc_id, min(other) AS class_id, doc_id = min(other) AS kept FROM reached GROUP BY doc_id
"""

#: A line goes if it lies in a run of at least five words that an earlier place has too. Of such a run some five lines
#: around it have five words already (a line has one at least), so runs of up to five lines tell.
OP9_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, pos, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (SELECT *, regexp_extract_all(raw, '{_word}') AS w FROM l) WHERE len(w) > 0),
d AS (SELECT doc_id, list(array_to_string(w, ' ') ORDER BY i) AS lines, list(len(w) ORDER BY i) AS words FROM n GROUP BY 1),
runs AS (SELECT doc_id, s, k, array_to_string(lines[s : s + k - 1], chr(10)) AS run FROM
  (SELECT doc_id, lines, words, k, unnest(range(1, len(lines) - k + 2)) AS s FROM d, range(1, 6) AS sizes(k) WHERE len(lines) >= k) WHERE list_sum(words[s : s + k - 1]) >= 5),
later AS (SELECT doc_id, s, k FROM (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY doc_id, s) AS nth FROM runs) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS i FROM later),
marked AS (SELECT n.doc_id, n.pos, n.i, gone.i IS NOT NULL AS g FROM n LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.i = n.i),
steps AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g) AS n_removed, count(*) FILTER (begins) AS n_runs FROM steps GROUP BY 1),
kept AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN marked m ON m.doc_id = l.doc_id AND m.pos = l.pos WHERE NOT coalesce(g, false) GROUP BY 1)
SELECT o.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  CASE WHEN o.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM documents o LEFT JOIN counts ON counts.doc_id = o.doc_id LEFT JOIN kept ON kept.doc_id = o.doc_id
"""
