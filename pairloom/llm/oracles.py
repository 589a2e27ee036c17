"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from pairloom.llm.licenses import PHRASES, TEMPLATES, THRESHOLD
from pairloom.llm.quality import DEPLETED, MIN_DOCS, MIN_SHARE

WORDS = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w)-1, 1))) AS i, w FROM d),
g AS (SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM p),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
lw AS (SELECT *, regexp_extract_all(line, '{WORDS}') AS ws FROM l),
le AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM lw WHERE len(ws) > 0),
du AS (SELECT doc_id, count(*) FILTER (nth > 1) AS n FROM le GROUP BY doc_id),
ln AS (SELECT doc_id, source, regexp_replace(lower(array_to_string(ws, ' ')), '\d+', '0', 'g') AS line, length(array_to_string(ws, '')) AS chars FROM le),
hs AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
fr AS (SELECT ln.source, line FROM ln JOIN hs ON ln.source IS NOT DISTINCT FROM hs.source GROUP BY ln.source, line, hs.docs HAVING count(DISTINCT doc_id) > {MIN_DOCS} AND count(DISTINCT doc_id) > {MIN_SHARE} * hs.docs),
lo AS (SELECT doc_id, sum(chars) AS n FROM ln JOIN fr ON ln.line = fr.line AND ln.source IS NOT DISTINCT FROM fr.source GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(du.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(lo.n, 0)::BIGINT AS boilerplate_chars
  FROM d LEFT JOIN du USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN lo USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100*n_repeat_words > 50*n_words) AS base_failed,
  NOT (n_words < 50 OR 100*n_repeat_words > 50*n_words) AND boilerplate_chars <= {DEPLETED}*word_chars AS kept, boilerplate_chars FROM f"""

JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)-2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
lk AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100*k >= 85*(p.n_shingles + q.n_shingles - k)),
b AS (SELECT x, y FROM lk UNION SELECT y, x FROM lk),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, b.y FROM reach JOIN b ON reach.other = b.x)
SELECT doc_id, n_shingles, component_id FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM k GROUP BY 1),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * v.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.whole + 2) // (v.n + 2 * v.v))::BIGINT AS q
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p)::HUGEINT * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
te AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q)::HUGEINT * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM te))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""

COLLOCATIONS = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({ASCII_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, unnest(w) AS phrase, 1 AS k FROM w UNION ALL
  SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])), 2 FROM w WHERE len(w) > 1 UNION ALL
  SELECT lang, unnest(list_transform(range(1, len(w)-1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])), 3 FROM w WHERE len(w) > 2),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
v AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, w FROM c),
u AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut+1:len(w)], ' ') AS rp FROM v),
x AS (SELECT u.lang, u.phrase, u.a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * u.a * u.a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM u
  JOIN f l ON l.lang = u.lang AND l.phrase = lp JOIN f r ON r.lang = u.lang AND r.phrase = rp),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
e AS (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE k = 3),
h AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN e ON e.lang = c.lang AND e.phrase = c.phrase AND 100 * e.a >= 50 * c.a),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y ANTI JOIN h USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) WHERE rank <= 2000"""

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _license_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quote(label)}, {quote(text)})" for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({quote(phrase)}, {quote(label)})" for phrase, label in PHRASES.items())
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, {ASCII_LOWER} AS text FROM documents),
w AS (SELECT id, doc_id, text, regexp_extract_all(text, '{LICENSE_WORD}') AS w FROM d),
ph AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {phrases}) AS x(phrase, label)),
i AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE text LIKE '%licens%' OR (text LIKE '%cc%' AND text LIKE '%nc%')),
pl AS (SELECT id, i - 1 AS place, label FROM i JOIN ph ON w[i : i + len(p) - 1] = p),
ba AS (SELECT id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM pl GROUP BY id),
te AS (SELECT t, label, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LICENSE_WORD}')) AS tokens FROM (VALUES {templates}) AS x(t, label, text)),
ln AS (SELECT id, unnest(string_split(text, chr(10))) AS body FROM d),
lw AS (SELECT id, regexp_extract_all(body, '{LICENSE_WORD}') AS w FROM ln),
bl AS (SELECT id, list_distinct(w[s : s + 95]) AS tokens FROM (SELECT id, w, unnest(CASE WHEN len(w) <= 96 THEN [1] ELSE range(1, len(w) - 47, 48) END) AS s FROM lw WHERE len(w) > 0)),
hi AS (SELECT id, label, len(list_intersect(te.tokens, bl.tokens)) AS o, len(te.tokens) AS m FROM bl JOIN te ON 100 * len(list_intersect(te.tokens, bl.tokens)) >= {THRESHOLD} * len(te.tokens)),
mo AS (SELECT id, list(DISTINCT label) AS labels, max(o / m) AS share FROM hi GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(ba.n, 0)::BIGINT AS n_base, ba.lo::BIGINT AS first_word, ba.hi::BIGINT AS last_word, coalesce(array_to_string(list_sort(ba.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(ba.labels, mo.labels))), ','), '') AS labels, CASE WHEN ba.n > 0 THEN 1.0::DOUBLE ELSE coalesce(mo.share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN ba USING (id) LEFT JOIN mo USING (id)"""


def sql() -> dict[str, str]:
    return {
        "op5_partenum_jaccard_join": JACCARD,
        "op7_line_frequency_rules": QUALITY,
        "op11_source_divergence": DIVERGENCE,
        "op12_phrase_collocations": COLLOCATIONS,
        "op13_license_containment": _license_sql(),
    }
