"""DuckDB SQL for the queries of this subpackage that SQL can express."""

SQL: dict[str, str] = {}

SQL["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT k, doc_id, t, host, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
f AS (SELECT k, doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
h AS (SELECT k, i, concat_ws(chr(32), w[i], w[i + 1], w[i + 2]) AS tri FROM g),
b AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, tri) AS c FROM h) WHERE c > 1),
r AS (SELECT k, count(DISTINCT i + o) AS n FROM b, (VALUES (0), (1), (2)) v(o) GROUP BY k),
m AS (SELECT f.*, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM f LEFT JOIN r USING (k)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS bad FROM m),
s AS (SELECT host, count(*) AS n, count(*) FILTER (bad) AS c FROM e GROUP BY host),
p AS (SELECT sum(c) / sum(n)::double AS mean, sum(c * c / n::double) / sum(n)::double - pow(sum(c) / sum(n)::double, 2) AS v FROM s),
q AS (SELECT mean, CASE WHEN v > 1e-12 THEN greatest(mean * (1 - mean) / v - 1, 1.0) ELSE 1e6 END AS strength FROM p),
x AS (SELECT host, n, (c + mean * strength) / (n + strength) AS rate FROM s, q)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
  n_repeat_words::bigint AS n_repeat_words, bad AS base_failed, NOT bad AND NOT (rate > 0.6 AND n >= 20) AS kept, round(rate, 9) AS host_rate
FROM e JOIN x USING (host)
"""


def _licenses() -> str:
    from .licenses import BLANK, END, JOIN, LATER, LEADER, NUMBER, OTHER, RIGHTS, SHORT, SLOTS, VERSION, known, patterns

    table = ", ".join(f"('{k}', '{v}')" for k, v in known().items())

    normal = rf"trim(regexp_replace(regexp_replace(x, '{NUMBER}', '#', 'g'), '{OTHER}', ' ', 'g'))"
    for pattern, sentence in SLOTS:
        normal = f"regexp_replace({normal}, '{pattern}', '{sentence}', 'g')"

    def reading(x: str, text: str) -> str:
        """Tables that end in {x}z: (r, s, n_known, q, rest, found) of each document."""
        steps, at = [], f"{x}q0"
        for i, (a, b, p) in enumerate(patterns(), 1):
            steps.append(f"{x}q{i} AS (SELECT * REPLACE (regexp_replace(rest, '{p}', '', 'g') AS rest, list_concat(found, list_transform(regexp_extract_all(rest, '{p}', 1), lambda v: '{a}' || v || '{b}')) AS found) FROM {at})")
            at = f"{x}q{i}"
        return rf"""
{x}s AS (SELECT r, list_filter(string_split(regexp_replace(regexp_replace({text}, '{VERSION}', 'v \1', 'g'), '{END}', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '{RIGHTS}')) AS s FROM d),
{x}u AS (SELECT r, unnest(s) AS x, unnest(range(len(s))) AS o FROM {x}s),
{x}m AS (SELECT r, o, '<' || k.i || '@' || regexp_extract(x, '\b([0-9]+(?:\.[0-9]+)*)', 1) || '>' AS e FROM {x}u
  JOIN k ON k.n = {normal}),
{x}g AS (SELECT r, count(*) AS n_known, string_agg(e, '' ORDER BY o) AS q FROM {x}m GROUP BY r),
{x}q0 AS (SELECT r, s, coalesce(n_known, 0) AS n_known, coalesce(q, '') AS q, coalesce(q, '') AS rest, []::varchar[] AS found FROM {x}s LEFT JOIN {x}g USING (r)),
{", ".join(steps)},
{x}z AS (SELECT * FROM {at})"""

    joined = f"translate(regexp_replace(regexp_replace(t, '{LEADER}', '\\1', 'g'), '{BLANK}', chr(2), 'g'), chr(10) || chr(2), ' ' || chr(10))"
    return rf"""
WITH k(n, i) AS (VALUES {table}),
c AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
h AS (SELECT r, doc_id, CASE WHEN regexp_matches(t, '{RIGHTS}') THEN t ELSE '' END AS t FROM c),
d AS (SELECT r, doc_id, regexp_replace(t, '{SHORT}', chr(10) || chr(10), 'g') || array_to_string(list_transform(list_filter(flatten(list_transform(regexp_extract_all(t, '{SHORT}', 1), lambda e: string_split_regex(e, '{JOIN}'))), lambda x: x <> ''),
  lambda x: chr(10) || chr(10) || 'spdx-license-identifier ' || regexp_replace(x, '{LATER}', '-or-later')), '') AS t FROM h),
{reading("l", "t")},
{reading("p", joined)},
b AS (SELECT d.doc_id, lz.n_known > pz.n_known AS by_line, lz, pz, CASE WHEN len(list_filter(regexp_extract_all(lz.q, '<([^@>]*)@', 1), lambda x: NOT list_contains(regexp_extract_all(pz.q, '<([^@>]*)@', 1), x))) > 0 THEN list_concat(pz.found, lz.found) ELSE pz.found END AS f FROM d JOIN lz ON d.r = lz.r JOIN pz ON d.r = pz.r),
w AS (SELECT doc_id, CASE WHEN by_line THEN lz ELSE pz END AS z, len(lz.s) > 0 OR len(pz.s) > 0 AS speaks, list_filter(f, lambda x, i: list_position(f, x) = i) AS l FROM b)
SELECT doc_id, len(z.s)::bigint AS n_sentences, z.n_known::bigint AS n_known, z.q AS sentence_ids, array_to_string(l, ',') AS licenses,
  (length(z.rest) - length(replace(z.rest, '>', '')))::bigint AS n_left,
  CASE WHEN len(l) > 1 THEN 'several' WHEN len(l) = 1 THEN 'one' WHEN speaks THEN 'unknown' ELSE 'none' END AS verdict FROM w
"""


SQL["op9_licenses"] = _licenses()

SQL["op3_decontamination"] = r"""
WITH s(c) AS (VALUES ('[\x00-\x2F\x3A-\x60\x7B-\x7F]+')),
d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT c FROM s)), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id::varchar AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT c FROM s)), lambda x: x <> '') AS w FROM benchmark),
j AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS gram FROM j),
g AS (SELECT k, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM v))),
h AS (SELECT DISTINCT k, p, n, item FROM g JOIN v USING (n, gram)),
c AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM h WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""


def _fill(parent: str, name: str, nodes: str) -> str:
    """Water-filling of a parent's budget b among its children (cap), all of weight one."""
    by = f"PARTITION BY {parent} ORDER BY cap, {name}" if parent else f"ORDER BY cap, {name}"
    over = f"(PARTITION BY {parent})" if parent else "()"
    return f"""SELECT * REPLACE (least(cap::double, 1.0 * top) AS b) FROM (SELECT *, max(level) OVER {over} AS top FROM (SELECT *, (b - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double)
  / sum(1.0::double) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ({nodes})))"""


SQL["op2_mixing"] = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, 'domain' || (instr('0123456789abcdef', left(md5(coalesce(source, '')), 1)) - 1) // 4 AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS n FROM documents),
leaf AS (SELECT domain, lang, source, sum(n)::bigint AS tokens, (2 * sum(n))::bigint AS cap FROM t GROUP BY ALL HAVING sum(n) > 0),
a AS ({_fill("", "domain", "SELECT domain, sum(cap)::bigint AS cap, (SELECT sum(tokens)::double FROM leaf) AS b FROM leaf GROUP BY domain")}),
l AS ({_fill("domain", "lang", "SELECT leaf.domain, leaf.lang, sum(leaf.cap)::bigint AS cap, any_value(a.b) AS b FROM leaf JOIN a ON leaf.domain = a.domain GROUP BY leaf.domain, leaf.lang")}),
s AS ({_fill("domain, lang", "source", "SELECT leaf.domain, leaf.lang, leaf.source, leaf.tokens, leaf.cap, l.b FROM leaf JOIN l ON leaf.domain = l.domain AND leaf.lang = l.lang")}),
q AS (SELECT domain, lang, source, floor(b)::bigint // tokens AS whole, floor(b)::bigint % tokens AS rest FROM s),
o AS (SELECT t.*, whole, rest, md5('17|' || whole || '|' || coalesce(doc_id::varchar, '')) AS h FROM t JOIN q USING (domain, lang, source)),
e AS (SELECT *, whole + (rest > 0 AND sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h) <= rest)::int AS times FROM o)
SELECT doc_id, domain, lang, source, n AS n_tokens, unnest(range(times))::bigint AS epoch FROM e
"""


SQL["op11_source_divergence"] = r"""
WITH d AS (SELECT coalesce(lang,'') lang, coalesce(source,'') source, row_number() over () k, coalesce(text,'') t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term FROM d),
c AS (SELECT lang, term, source, count(*) n FROM w GROUP BY ALL),
v AS (SELECT lang, term, count(DISTINCT k) docs, count(*) n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
l AS (SELECT lang, count(*) vv, sum(n)::hugeint nn FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN v USING (lang, term)),
s AS (SELECT g.lang, g.source, coalesce(sum(k.n),0)::hugeint nn FROM g LEFT JOIN k USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, v.term, coalesce(k.n,0) n, (1 + 1000000000::hugeint*(coalesce(k.n,0)+5) // (s.nn + 5*l.vv))::bigint p, (1 + 1000000000::hugeint*(v.n+5) // (l.nn + 5*l.vv))::bigint q
  FROM s JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN k ON k.lang=s.lang AND k.source=s.source AND k.term=v.term),
e AS (SELECT a.lang, a.source, b.source item, sum(abs(a.p-b.p))::bigint x FROM p a JOIN p b ON a.lang=b.lang AND a.term=b.term AND a.source<>b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(e.x, 0)::bigint AS value FROM g a JOIN g b ON a.lang=b.lang AND a.source<>b.source LEFT JOIN e ON e.lang=a.lang AND e.source=a.source AND e.item=b.source),
u AS (SELECT * FROM pr UNION ALL SELECT lang, source, 'term', term, p-q FROM p WHERE n>0 AND p>q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part='pair' OR rank<=50
"""

SQL["op12_collocations"] = r"""
WITH t AS (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT k, lang, unnest(p) AS p, unnest(range(len(p))) AS j FROM t),
w AS (SELECT k, j, lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i] AS phrase, 1 AS size FROM x UNION ALL SELECT lang, w[i] || ' ' || w[i + 1], 2 FROM x WHERE i < len(w) UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM x WHERE i + 1 < len(w)),
f AS (SELECT lang, phrase, size, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
c AS (SELECT lang, phrase, size, a, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
h AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, l.a AS l, r.a AS r, (1000000::hugeint * c.a * c.a // (l.a::hugeint * r.a))::bigint AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
s AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase, a FROM c WHERE size = 3) GROUP BY ALL),
o AS (SELECT s.*, n.n, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM s JOIN n USING (lang) LEFT JOIN m ON m.lang = s.lang AND m.phrase = s.phrase WHERE around IS NULL OR 100 * around < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
