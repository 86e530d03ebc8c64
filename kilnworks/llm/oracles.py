"""SQL that checks the corpus queries, for DuckDB."""

from __future__ import annotations

from kilnworks.llm.licences import LEAST_DICE, NOTICES

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licences() -> str:
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(NOTICES.items()))
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH notices(licence, notice) AS (VALUES {values}),
t AS (SELECT licence, len(w) AS n, list_distinct({grams}) AS b FROM (SELECT licence, {_WORDS.format(x='notice')} AS w FROM notices)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, string_split(text, chr(10)) AS l, text FROM d),
u AS (SELECT r, 0 AS unit, text AS x FROM l WHERE len(l) > 1
      UNION ALL SELECT r, i AS unit, l[i] AS x FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
g AS (SELECT r, unit, list_distinct({grams}) AS b FROM (SELECT r, unit, {_WORDS.format(x='x')} AS w FROM u)),
m AS (SELECT r, unit, NULL AS word_start, licence, len(list_intersect(g.b, t.b)) AS shared, len(g.b) AS n_text, len(t.b) AS n_notice
      FROM g JOIN t ON len(g.b) > 0 AND len(g.b) <= 2 * len(t.b) AND len(t.b) <= 2 * len(g.b)),
a AS (SELECT r, {grams} AS g FROM (SELECT r, {_WORDS.format(x='text')} AS w FROM d)),
c AS (SELECT r, g, licence, n, b FROM a JOIN t ON len(list_intersect(g, b)) * 1.5 >= len(b)),
p AS (SELECT r, g, licence, n, b, i FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM c) WHERE list_contains(b, g[i])),
w AS (SELECT r, NULL AS unit, i - 1 AS word_start, licence, len(list_intersect(list_distinct(x), b)) AS shared, len(list_distinct(x)) AS n_text, len(b) AS n_notice
      FROM (SELECT *, g[i:i + n - 2] AS x FROM p)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY 2.0 * shared / (n_text + n_notice) DESC, shared DESC, licence,
        unit NULLS LAST, word_start) AS k
      FROM (SELECT * FROM m UNION ALL SELECT * FROM w) WHERE 2.0 * shared / (n_text + n_notice) >= {LEAST_DICE}) WHERE k = 1)
SELECT doc_id, licence, shared, n_text, n_notice, unit, word_start FROM d LEFT JOIN best USING (r)"""


def quality(max_documents: int, least_words: int, least_percent: int) -> str:
    ws = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i AS p, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
dup AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, coalesce(q, p + 8) - p)) AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM dup) GROUP BY r),
ls AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
e AS (SELECT r, trim(regexp_replace(lower(l), '{ws}+', ' ', 'g')) AS l FROM (SELECT r, unnest(l) AS l FROM ls)),
freq AS (SELECT host, l FROM e JOIN d USING (r) GROUP BY host, l HAVING count(DISTINCT (doc_id, text)) > {max_documents}),
cut AS (SELECT r, count(*) AS removed_lines, sum(length(l) - length(replace(l, ' ', '')) + 1) AS removed_words
        FROM e JOIN d USING (r) JOIN freq USING (host, l) GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
      FROM d JOIN w USING (r) JOIN ls USING (r) LEFT JOIN cov USING (r) LEFT JOIN cut USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words - removed_words < {least_words} OR 100 * (n_words - removed_words) < {least_percent} * n_words) AS kept,
       removed_lines, removed_words FROM f"""


def leaked(source: str = "documents", k: int = 5, percent: int = 80) -> str:
    """The best of all windows of each document and item; no SimHash, so it also shows what the radius might lose.

    A document that holds too few of an item's shingles for any window is not looked at further.
    """
    grams = "list_transform(range(1, len({w}) - k + 2), lambda i: array_to_string({w}[i:i + k - 1], ' '))"
    return f"""
WITH b AS (SELECT item_id, w, len(w) AS n, least({k}, len(w)) AS k FROM (SELECT DISTINCT item_id, {_WORDS.format(x='text')} AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT item_id, n, k, {grams.format(w='w')} AS s FROM b),
bp AS (SELECT item_id, n, k, o - 1 AS o, s[o] AS h FROM (SELECT item_id, n, k, s, unnest(range(1, len(s) + 1)) AS o FROM bs)),
d AS (SELECT DISTINCT doc_id, text, {_WORDS.format(x='text')} AS w FROM {source}),
dr AS (SELECT row_number() OVER () AS r, doc_id, w FROM d),
dk AS (SELECT r, w, k FROM dr CROSS JOIN (SELECT DISTINCT k FROM b)),
ds AS (SELECT r, k, len(w) AS nd, {grams.format(w='w')} AS s FROM dk WHERE len(w) >= k),
dp AS (SELECT r, k, nd, p - 1 AS p, s[p] AS h FROM (SELECT r, k, nd, s, unnest(range(1, len(s) + 1)) AS p FROM ds)),
hits AS (SELECT r, item_id, n, nd FROM dp JOIN (SELECT DISTINCT item_id, n, k, h FROM bp) USING (k, h) GROUP BY r, item_id, n, nd, k
      HAVING 100 * count(*) * 2 >= {percent} * (n + least(n, nd) - 2 * k + 2 - count(*)) OR count(*) >= n),
win AS (SELECT r, doc_id, item_id, start, k, list_slice(w, start + 1, start + n) AS x, s AS si
      FROM (SELECT r, item_id, unnest(range(0, greatest(0, nd - n) + 1)) AS start FROM hits) JOIN dr USING (r) JOIN bs USING (item_id)),
ws AS (SELECT r, doc_id, item_id, start, si, {grams.format(w='x')} AS s FROM win),
c AS (SELECT r, doc_id, item_id, start, len(s) + len(si) AS sizes,
        CAST(list_sum(list_transform(list_distinct(s), lambda h: least(len(list_filter(s, lambda y: y = h)), len(list_filter(si, lambda y: y = h))))) AS BIGINT) AS shared FROM ws),
z AS (SELECT r, doc_id, item_id, start, shared, sizes - shared AS total FROM c WHERE 100 * shared >= {percent} * (sizes - shared))
SELECT doc_id, item_id, start AS window_start, shared, total
FROM (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY shared / total DESC, start) AS q FROM z) WHERE q = 1"""


def deduplicated_lines(least_words: int, source: str = "documents") -> str:
    """Runs compared as whole strings, without ranks: the shortest that count from each line on and up to each line, which cover all longer ones."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM {source}),
a AS (SELECT r, doc_id, text, n, l[n] AS x FROM (SELECT r, doc_id, text, l, unnest(range(1, len(l) + 1)) AS n FROM d)),
s AS (SELECT r, doc_id, text, n, x, row_number() OVER (PARTITION BY r ORDER BY n) - 1 AS i,
        len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM a WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
p AS (SELECT *, sum(w) OVER (PARTITION BY r ORDER BY i) - w AS before, count(*) OVER (PARTITION BY r) AS nl FROM s),
long AS (SELECT p.r, p.i, q.i AS j FROM p JOIN p q ON p.r = q.r AND q.i >= p.i AND q.before + q.w >= p.before + {least_words}),
e AS (SELECT r, i, min(j) - i + 1 AS m FROM long GROUP BY r, i UNION SELECT r, max(i) AS i, j - max(i) + 1 AS m FROM long GROUP BY r, j),
ls AS (SELECT r, doc_id, any_value(text) AS text, list(x ORDER BY i) AS xs, list(n ORDER BY i) AS ns FROM s GROUP BY r, doc_id),
win AS (SELECT r, doc_id, text, i, m, array_to_string(xs[i + 1:i + m], chr(10)) AS run FROM e JOIN ls USING (r)),
first AS (SELECT run, min((coalesce(doc_id, -9223372036854775808), md5(text), i)) AS f, min(doc_id) AS lowest FROM win GROUP BY run),
gone AS (SELECT DISTINCT r, n FROM (SELECT r, unnest(range(ns[i + 1], ns[i + m] + 1)) AS n FROM win JOIN first USING (run) JOIN ls USING (r)
        WHERE (coalesce(win.doc_id, -9223372036854775808), md5(win.text), i) <> f)),
kept AS (SELECT r, string_agg(x, chr(10) ORDER BY n) AS x FROM a ANTI JOIN gone USING (r, n) GROUP BY r),
c AS (SELECT r, count(*) AS n_removed FROM gone JOIN s USING (r, n) GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.x, '') END) AS kept_md5
FROM d LEFT JOIN kept USING (r) LEFT JOIN c USING (r)"""


def phrases(least: int, cover: int, top: int) -> str:
    """Phrases as strings, all n-grams counted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p),
pos AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, j, array_to_string(w[i:i + j - 1], ' ') AS p FROM pos, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE i + j - 1 <= len(w)),
f AS (SELECT lang, j, p, count(*) AS a FROM g GROUP BY lang, j, p HAVING count(*) >= {least}),
c AS (SELECT lang, j, p, a, string_split(p, ' ') AS w FROM f WHERE j > 1),
cuts AS (SELECT lang, j, p, a, w, unnest(range(1, j)) AS k FROM c),
z AS (SELECT cuts.lang, cuts.p, cuts.a, k, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * cuts.a) // (x.a + y.a) AS BIGINT) AS score FROM cuts
      JOIN f x ON x.lang = cuts.lang AND x.p = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.p = array_to_string(w[k + 1:], ' ')),
s AS (SELECT lang, p, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS q FROM z) WHERE q = 1),
inside AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS p, a AS longer FROM
      (SELECT lang, j, w, a, m, unnest(range(1, j - m + 2)) AS i FROM (SELECT lang, j, w, a, unnest(range(2, j)) AS m FROM c))),
gone AS (SELECT DISTINCT s.lang, s.p FROM s JOIN inside USING (lang, p) WHERE CAST(100 AS HUGEINT) * longer >= CAST({cover} AS HUGEINT) * s.a),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
o AS (SELECT lang, p, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM s ANTI JOIN gone USING (lang, p))
SELECT lang, rank, p AS phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {top}"""


def searched(top: int) -> str:
    """Every score, summed over all postings."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT r, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents) WHERE len(w) > 0),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS term FROM
      (SELECT row_number() OVER () AS i, item_id, {terms} AS w FROM benchmark)) GROUP BY i, item_id, term),
t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * n * nd) // nl) AS m FROM d, s),
z AS (SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM z WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {top}"""
