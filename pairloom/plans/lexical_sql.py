"""DuckDB SQL of the lexical families."""

from pairloom.functions.text import CONTRACTION_RULES, STOPWORDS, TOKEN_PATTERN
from pairloom.operators.lexical import QUESTION_WORDS
from pairloom.sources.pairs import PAIRS_SQL

STOPS = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS) + "]"


def words(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> '')"


def tokens(c: str, lower: bool = True) -> str:
    return f"regexp_extract_all({f'lower({c})' if lower else c}, '{TOKEN_PATTERN}')"


def contraction_tokens(c: str) -> str:
    out = f"' ' || regexp_replace(lower({c}), '\\s+', ' ', 'g') || ' '"
    for pattern, into in CONTRACTION_RULES:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), into.replace("'", "''").replace("$", "\\"))
    return f"list_filter(string_split_regex({out}, '\\s+'), lambda w: w <> '')"


def nostops(c: str) -> str:
    return f"list_filter({c}, lambda w: NOT list_contains({STOPS}, w))"


def stops(c: str) -> str:
    return f"list_filter({c}, lambda w: list_contains({STOPS}, w))"


def grams(c: str, n: int) -> str:
    joined = " || ' ' || ".join(f"{c}[i+{k}]" for k in range(n))
    return f"list_transform(range(1, greatest(len({c})-{n - 1}, 0)+1), lambda i: {joined})"


def chars(c: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({c})-{n - 1}, 0)+1), lambda i: substr({c}, i, {n}))"


def pairs_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([PAIRS_SQL, *ctes]) + "\n" + body


def div(x: str, y: str) -> str:
    return f"(({x})::DOUBLE / nullif(({y})::DOUBLE, 0))"


TEXTS = "x AS (SELECT *, coalesce(question1, 'nan') AS a, coalesce(question2, 'nan') AS b FROM pairs)"
EMPTY_TEXTS = "x AS (SELECT *, coalesce(question1, '') AS a, coalesce(question2, '') AS b FROM pairs)"


def rounded(names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())


SQL = {
    "pair_len": pairs_sql(
        f"SELECT *, round({div('abs(char_len1-char_len2)', 'char_len1+char_len2')}, 6) AS char_len_diff_ratio, round({div('abs(word_len1-word_len2)', 'word_len1+word_len2')}, 6) AS word_len_diff_ratio FROM y",
        TEXTS, f"y AS (SELECT pair_id, length(a)::INT AS char_len1, length(b)::INT AS char_len2, len({words('a')})::INT AS word_len1, len({words('b')})::INT AS word_len2 FROM x)",
    ),
    "pair_caps": pairs_sql(
        "SELECT pair_id, caps_count_q1, caps_count_q2, caps_count_q1-caps_count_q2 AS diff_caps, round(m1, 6) AS avg_world_len1, round(m2, 6) AS avg_world_len2, round(m1-m2, 6) AS diff_avg_word FROM y",
        TEXTS, "y AS (SELECT pair_id, " + ", ".join(f"length(regexp_replace({c}, '[^\\p{{Lu}}]', '', 'g'))::INT AS caps_count_q{i}, {div(f'''length(replace({c}, ' ', ''))''', f'len({words(c)})')} AS m{i}" for i, c in ((1, "a"), (2, "b"))) + " FROM x)",
    ),
    "pair_question_words": pairs_sql("SELECT pair_id, " + ", ".join(f"contains(lower(a), '{w}')::INT AS q1_{w}, contains(lower(b), '{w}')::INT AS q2_{w}, (contains(lower(a), '{w}') AND contains(lower(b), '{w}'))::INT AS {w}_both" for w in QUESTION_WORDS) + " FROM x", TEXTS),
    "pair_capped_len": pairs_sql(
        "SELECT pair_id, len1, len2, round(d, 6) AS abs_diff_len1_len2, round(ln(d+1), 6) AS log_abs_diff_len1_len2, round(r, 6) AS ratio_len1_len2, round(ln(r+1), 6) AS log_ratio_len1_len2 FROM z",
        EMPTY_TEXTS, "y AS (SELECT pair_id, split, is_duplicate, length(a)::DOUBLE AS len1, length(b)::DOUBLE AS len2, abs(length(a)-length(b))::DOUBLE AS diff, greatest(length(a),1)::DOUBLE/greatest(length(b),1) AS rat FROM x)",
        "c AS (SELECT max(diff)+2*stddev_samp(diff) AS cd, max(rat)+2*stddev_samp(rat) AS cr FROM y WHERE split='train' AND is_duplicate=1)", "z AS (SELECT pair_id, len1, len2, least(diff, cd) AS d, least(rat, cr) AS r FROM y, c)",
    ),
    "pair_match": pairs_sql(
        "SELECT pair_id, nm::INT AS noun_match_count, round(coalesce(" + div("nm", "len(n1)+len(n2)") + ", 0), 6) AS noun_match_ratio, round(CASE WHEN len(w1)=0 OR len(w2)=0 THEN 0 ELSE " + div("2*len(list_intersect(w1,w2))", "len(w1)+len(w2)") + " END, 6) AS word_match_ratio, "
        + ", ".join(f"len(list_intersect({g}1, {g}2))::INT AS {n}_nostop_match_count, round({div(f'len(list_intersect({g}1, {g}2))', f'greatest(len(list_distinct(list_concat({g}1, {g}2))), 1)')}, 6) AS {n}_nostop_match_ratio" for g, n in (("g", "unigrams"), ("h", "bigrams"), ("t", "trigrams"))) + " FROM z",
        TEXTS, "y AS (SELECT pair_id, " + ", ".join(f"list_distinct({nostops(words(c))}) AS w{i}, {nostops(tokens(c))} AS u{i}" for i, c in ((1, "a"), (2, "b"))) + " FROM x)",
        "n AS (SELECT *, list_filter(u1, lambda w: length(w) >= 4) AS n1, list_filter(u2, lambda w: length(w) >= 4) AS n2 FROM y)",
        "z AS (SELECT *, len(list_filter(n1, lambda w: list_contains(n2, w))) AS nm, u1 AS g1, u2 AS g2, " + ", ".join(f"{grams(f'u{i}', n)} AS {g}{i}" for g, n in (("h", 2), ("t", 3)) for i in (1, 2)) + " FROM n)",
    ),
    "pair_match_contractions": pairs_sql(
        "SELECT pair_id, " + ", ".join(f"len(list_intersect({g}1, {g}2))::INT AS {n}_nostop_match_count, round({div(f'len(list_intersect({g}1, {g}2))', f'greatest(len(list_distinct(list_concat({g}1, {g}2))), 1)')}, 6) AS {n}_nostop_match_ratio" for g, n in (("g", "unigrams"), ("h", "bigrams"), ("t", "trigrams"))) + " FROM z",
        TEXTS, "y AS (SELECT pair_id, " + ", ".join(f"{nostops(contraction_tokens(c))} AS u{i}" for i, c in ((1, "a"), (2, "b"))) + " FROM x)",
        "z AS (SELECT pair_id, u1 AS g1, u2 AS g2, " + ", ".join(f"{grams(f'u{i}', n)} AS {g}{i}" for g, n in (("h", 2), ("t", 3)) for i in (1, 2)) + " FROM y)",
    ),
    "pair_word_weights": pairs_sql(f"SELECT word, round(CASE WHEN count(*) < 2 THEN 0 ELSE 1.0::DOUBLE/(count(*)+10000) END, 12) AS weight FROM (SELECT unnest({words('q')}) AS word FROM (SELECT a AS q FROM x WHERE split='train' UNION ALL SELECT b FROM x WHERE split='train')) GROUP BY word", TEXTS),
    "pair_weighted_share": pairs_sql(
        "SELECT pair_id, " + ", ".join(f"round(CASE WHEN none THEN 0 ELSE {e} END, 6) AS {n}" for n, e in {
            "word_match_ratio_2": div("shared", "total"), "word_match_ratio_2_root": "sqrt(" + div("shared", "total") + ")",
            "tfidf_word_match_ratio_2": div("len(list_intersect(s1,s2))", "len(s1)+len(s2)-len(list_intersect(s1,s2))"),
            "stops1_ratio": div("len(t1)", "len(s1)"), "stops2_ratio": div("len(t2)", "len(s2)"), "diff_stops_r": f"{div('len(t1)', 'len(s1)')}-{div('len(t2)', 'len(s2)')}",
            "shared_2gram": f"coalesce({div('len(list_intersect(b1,b2))', 'len(b1)+len(b2)')}, 0)", "word_match_cosine": div("dot", "norm1*norm2"),
            "words_hamming": div("len(list_filter(range(1, least(len(l1),len(l2))+1), lambda i: l1[i]=l2[i]))", "greatest(len(l1),len(l2))"),
        }.items()) + ", CASE WHEN none THEN 0 ELSE len(list_intersect(s1,s2)) END::INT AS shared_count_2 FROM z",
        TEXTS, f"c AS (SELECT word, CASE WHEN count(*) < 2 THEN 0 ELSE 1.0::DOUBLE/(count(*)+10000) END AS wt FROM (SELECT unnest({words('q')}) AS word FROM (SELECT a AS q FROM x WHERE split='train' UNION ALL SELECT b FROM x WHERE split='train')) GROUP BY word)",
        f"l AS (SELECT pair_id, {words('a')} AS l1, {words('b')} AS l2 FROM x)", f"s AS (SELECT *, list_distinct({nostops('l1')}) AS s1, list_distinct({nostops('l2')}) AS s2, list_distinct({stops('l1')}) AS t1, list_distinct({stops('l2')}) AS t2, list_distinct({grams('l1', 2)}) AS b1, list_distinct({grams('l2', 2)}) AS b2 FROM l)",
        "m AS (SELECT pair_id, s1, s2, unnest(list_distinct(list_concat(s1,s2))) AS word FROM s)",
        "g AS (SELECT pair_id, sum(coalesce(wt,0)*i1*i2) AS shared, sum(coalesce(wt,0)*(i1+i2)) AS total, sum(wt*wt*i1*i2) AS dot, sqrt(sum(wt*wt*i1)) AS norm1, sqrt(sum(wt*wt*i2)) AS norm2 FROM (SELECT pair_id, word, list_contains(s1,word)::INT AS i1, list_contains(s2,word)::INT AS i2 FROM m) LEFT JOIN c USING (word) GROUP BY pair_id)",
        "z AS (SELECT *, len(s1)=0 OR len(s2)=0 AS none FROM s LEFT JOIN g USING (pair_id))",
    ),
    "pair_char_jaccard": pairs_sql(
        "SELECT pair_id, " + ", ".join(
            f"round({d(div(f'len(list_intersect({g}1,{g}2))', f'len(list_distinct(list_concat({g}1,{g}2)))'))}, 6) AS {n}_jaccard, round({d(div(low, both))}, 6) AS {n}_all_jaccard, round({d(div(low, f'{both}-({low})'))}, 6) AS {n}_all_jaccard_max"
            for g, n, d in (("u", "unigram", str), ("b", "bigram", str), ("t", "trigram", lambda e: f"coalesce({e}, 0)"))
            for low, both in [(f"coalesce(list_sum(list_transform(list_intersect({g}1,{g}2), lambda g: least(len(list_filter({g}1, lambda o: o=g)), len(list_filter({g}2, lambda o: o=g))))), 0)", f"(len({g}1)+len({g}2))")]
        ) + " FROM z",
        EMPTY_TEXTS, "z AS (SELECT pair_id, " + ", ".join(f"{chars(f'lower({c})', n)} AS {g}{i}" for g, n in (("u", 1), ("b", 2), ("t", 3)) for i, c in ((1, "a"), (2, "b"))) + " FROM x)",
    ),
}


def _bits(g: str, at: int) -> str:
    h = f"list_transform({g}, lambda g: ('0x'||substr(md5(g),{at},8))::BIGINT)"
    return f"coalesce(list_sum(list_transform(range(0,32), lambda b: CASE WHEN list_sum(list_transform({h}, lambda v: 2*((v >> b) & 1)-1)) > 0 THEN 1::BIGINT << b ELSE 0 END)), 0)::BIGINT"


_KINDS = {"tokenize": "k{i}", "word_2gram": grams("k{i}", 2), "char_2gram": chars("c{i}", 2), "word_3gram": grams("k{i}", 3), "char_3gram": chars("c{i}", 3)}
SQL["pair_simhash"] = pairs_sql(
    "SELECT pair_id, " + ", ".join(f"(bit_count(xor({n}_1h, {n}_2h)) + bit_count(xor({n}_1l, {n}_2l)))::INT AS simhash_{n}_distance" for n in _KINDS) + " FROM z",
    TEXTS, "y AS (SELECT pair_id, " + ", ".join(f"{nostops(tokens(c, False))} AS k{i}, array_to_string({nostops(tokens(c, False))}, ' ') AS c{i}" for i, c in ((1, "a"), (2, "b"))) + " FROM x)",
    "w AS (SELECT pair_id, " + ", ".join(f"{g.replace('{i}', str(i))} AS {n}_{i}" for n, g in _KINDS.items() for i in (1, 2)) + " FROM y)",
    "z AS (SELECT pair_id, " + ", ".join(f"{_bits(f'{n}_{i}', at)} AS {n}_{i}{s}" for n in _KINDS for i in (1, 2) for s, at in (("h", 17), ("l", 25))) + " FROM w)",
)
