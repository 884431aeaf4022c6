"""DuckDB SQL of the queries that SQL can express.

The others (formats with offsets, iterated rates, tokenizers, XXH64 fingerprints, masks with
tolerance) are held against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from kindred.llm import divergence, licences, lines, quality, urls

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op4() -> str:
    bit = quality.BITS
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(8) r(j) GROUP BY doc_id),
m AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}')))::BIGINT AS n_upper_words
  FROM l LEFT JOIN cov ON l.doc_id = cov.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN {bit['few_words']} ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN {bit['repeated_words']} ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN {bit['many_symbols']} ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN {bit['repeated_lines']} ELSE 0 END
  + CASE WHEN 10 * n_letter_words < 7 * n_words THEN {bit['few_letters']} ELSE 0 END + CASE WHEN 2 * n_upper_words > n_words THEN {bit['shouting']} ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN {bit['short_words']} ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN {bit['long_words']} ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f"""


def _op6() -> str:
    return rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
late AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS pos FROM late GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(pos), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN pos IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(pos, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""


def _op7() -> str:
    line = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"' ' || trim(regexp_replace(regexp_replace({line}, {_quoted(licences.INNER)}, '', 'g'), '{licences.BETWEEN}', ' ', 'g')) || ' '"
    for a, b in licences.SPELLINGS.items():
        words = f"replace(replace({words}, ' {a} ', ' {b} '), ' {a} ', ' {b} ')"
    known = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licences.KNOWN)
    return rf"""
WITH texts AS (SELECT doc_id, '' AS licence, text FROM documents UNION ALL SELECT NULL, licence, text FROM (VALUES {known}) k(licence, text)),
c AS (SELECT doc_id, licence, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
  lambda x: CASE WHEN regexp_matches({line}, '{licences.COPYRIGHT_LINE}') THEN '' ELSE trim({words}) END), lambda x: x <> '') AS ls FROM texts),
d AS (SELECT doc_id, licence, ls, CASE WHEN len(ls) > 0 THEN sha256(array_to_string(ls, ' ')) END AS digest FROM c),
k AS (SELECT digest, min(licence) AS licence FROM d WHERE licence <> '' AND digest IS NOT NULL GROUP BY digest),
own AS (SELECT doc_id, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS line_licences
  FROM (SELECT doc_id, sha256(unnest(ls)) AS digest FROM d WHERE licence = '') u JOIN k USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.licence, own.line_licences, len(ls)::BIGINT AS n_lines
FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN own ON d.doc_id = own.doc_id WHERE d.licence = ''"""


def _op8() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")
    scheme = lower.format("regexp_extract(url, '(?s)^(.*?)://', 1)")
    node = rf"CASE WHEN {host} <> '' THEN {scheme} || '://' || {host} || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"
    return rf"""
WITH RECURSIVE
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
links AS (SELECT url AS base, trim(replace(regexp_extract(tag, '(?is)\shref\s*=\s*["'']([^"'']*)["'']', 1), '&amp;', '&')) AS target FROM tags
    WHERE regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\srel\s*=\s*["'']?([^"''>]*\s)?canonical["''\s/>]')
  UNION ALL SELECT url, trim(regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''>;]+)', 1)) FROM tags
    WHERE regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh["''\s/>]')),
targets AS (SELECT base, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN target LIKE '//%' THEN regexp_extract(base, '(?s)^(.*?)://', 1) || ':' || target
    WHEN target LIKE '/%' THEN regexp_extract(base, '(?s)^(.*?://[^/?#]*)', 1) || target END AS url FROM links WHERE target <> ''),
edges AS (SELECT (SELECT {node} FROM (SELECT base AS url)) AS a, {node} AS b FROM targets WHERE url IS NOT NULL),
sides AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a, a AS b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
rules(verdict, h, p) AS (VALUES {rules}),
p AS (SELECT page_id, coalesce({host}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {node} AS node FROM pages),
n AS (SELECT DISTINCT node, host, path FROM (SELECT node, host, path FROM p UNION ALL
  SELECT b, regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1), regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1) FROM sides)),
fit AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM n) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
inherited AS (SELECT reach.a AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict
  FROM reach JOIN n ON reach.b = n.node LEFT JOIN fit USING (host, path) GROUP BY reach.a)
SELECT page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, inherited.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit USING (host, path) LEFT JOIN inherited ON p.node = inherited.node"""


def _op10() -> str:
    return rf"""
WITH l AS (SELECT doc_id, pos, x, {WORDS.replace('text', 'x')} AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
f AS (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min((doc_id, pos)) AS first FROM l WHERE len(w) > 0 GROUP BY 1),
v AS (SELECT s, first, i, false AS whole, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= {lines.LEAST})
  UNION ALL SELECT s, first, i, true, s FROM (SELECT *, unnest(range(1, len(w) + 2)) AS i FROM f WHERE len(w) >= {lines.LEAST})),
near AS (SELECT DISTINCT s FROM (SELECT s FROM v QUALIFY min(first) OVER (PARTITION BY v, i) < first)),
j AS (SELECT l.doc_id, l.pos, l.x, f.s IS NOT NULL AND (near.s IS NOT NULL OR f.first <> (l.doc_id, l.pos)) AS gone
  FROM l LEFT JOIN f ON f.s = array_to_string(l.w, ' ') AND len(l.w) > 0 LEFT JOIN near ON near.s = f.s)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(x, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM j GROUP BY doc_id) USING (doc_id)"""


def _op11() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.LEAST}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + {divergence.SCALE}::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM dense),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + {divergence.SCALE}::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f
QUALIFY part = 'pair' OR rank <= {divergence.RANKS}"""


ORACLE: dict[str, str] = {
    "op4_rule_ledger": _op4(),
    "op6_seed_extend": _op6(),
    "op7_licence_digests": _op7(),
    "op8_redirect_filter": _op8(),
    "op10_line_edits": _op10(),
    "op11_hash_recount": _op11(),
}
