"""DuckDB SQL of the vector, graph, sequence, model and post-processing queries."""

from pairloom.plans.lexical_sql import EMPTY_TEXTS, STOPS, TEXTS, chars, div, nostops, pairs_sql, tokens

DIMS = 64
UNPIVOT = "SELECT pair_id, 1 AS side, a AS text FROM x UNION ALL SELECT pair_id, 2, b FROM x"
# Stand-in scores for rules and metrics: a fixed function of the pair.
SCORE = "((pair_id * 7919 + 13) % 1000)::DOUBLE / 1000"
SCORED = f"sc AS (SELECT pair_id, question1, question2, split, is_duplicate, {SCORE} AS p FROM pairs)"


def _weighted(terms: str, idf: bool, power: int) -> tuple[str, ...]:
    raw = "tf*(ln((1.0::DOUBLE+n)/(1.0::DOUBLE+df))+1)" if idf else "tf::DOUBLE"
    size = "sum(raw)" if power == 1 else "sqrt(sum(raw*raw))"
    return (
        f"s AS ({UNPIVOT})", f"t AS (SELECT pair_id, side, term, count(*) AS tf FROM (SELECT pair_id, side, unnest({terms}) AS term FROM s) GROUP BY ALL)",
        "d AS (SELECT term, count(*) AS df FROM t GROUP BY term)", "nn AS (SELECT count(*) AS n FROM s)",
        f"w AS (SELECT pair_id, side, term, {raw} AS raw FROM t JOIN d USING (term), nn)", f"z AS (SELECT pair_id, side, {size} AS size FROM w GROUP BY ALL)",
        "u AS (SELECT pair_id, side, term, raw/size AS wt FROM w JOIN z USING (pair_id, side))",
    )


def _distance(name: str, terms: str, idf: bool, power: int, kind: str) -> str:
    value = "CASE WHEN coalesce(sum(w1),0)>0 AND coalesce(sum(w2),0)>0 THEN 1-sum(coalesce(w1,0)*coalesce(w2,0)) ELSE 0 END" if kind == "cosine" else "sqrt(sum((coalesce(w1,0)-coalesce(w2,0))*(coalesce(w1,0)-coalesce(w2,0))))"
    body = f"SELECT p.pair_id, round(coalesce(v, 0), 6) AS {name} FROM pairs p LEFT JOIN (SELECT pair_id, {value} AS v FROM (SELECT pair_id, term, wt AS w1 FROM u WHERE side=1) FULL JOIN (SELECT pair_id, term, wt AS w2 FROM u WHERE side=2) USING (pair_id, term) GROUP BY pair_id) USING (pair_id)"
    return "(WITH " + ", ".join(_weighted(terms, idf, power)) + " " + body + ")"


def _distances(prefix: str, terms: str, kinds: dict) -> str:
    subs = [_distance(f"{prefix}_{n}", terms, *k) for n, k in kinds.items()]
    return pairs_sql("SELECT * FROM " + " JOIN ".join(f"{s} AS s{i}" if not i else f"{s} AS s{i} USING (pair_id)" for i, s in enumerate(subs)), EMPTY_TEXTS)


TRIGRAM_KINDS = {"tfidf_cosine": (True, 2, "cosine"), "tfidf_l2_euclidean": (True, 2, "euclidean"), "tfidf_l1_euclidean": (True, 1, "euclidean"), "tf_l2_euclidean": (False, 2, "euclidean")}
LEMMA_KINDS = {k: v for k, v in TRIGRAM_KINDS.items() if k != "tfidf_l1_euclidean"}

_EDGE = "SELECT coalesce(question1,'{n}') AS src, coalesce(question2,'{n}') AS dst FROM pairs UNION {a} SELECT coalesce(question2,'{n}'), coalesce(question1,'{n}') FROM pairs"
SIMPLE, MULTI = _EDGE.format(n="", a=""), _EDGE.format(n="", a="ALL")
STEPS = 5



def _pagerank(steps: int) -> str:
    step = "r{i} AS MATERIALIZED (SELECT dst AS node, 0.15/(SELECT count(*) FROM dg)+0.85*sum(pr/d) AS pr FROM ed JOIN dg USING (src) JOIN r{j} ON src=node GROUP BY dst)"
    return pairs_sql(
        f"SELECT pair_id, round(r1.pr, 9) AS q1_pr, round(r2.pr, 9) AS q2_pr FROM pairs JOIN r{steps} r1 ON coalesce(question1,'')=r1.node JOIN r{steps} r2 ON coalesce(question2,'')=r2.node",
        f"ed AS MATERIALIZED ({MULTI})", "dg AS MATERIALIZED (SELECT src, count(*) AS d FROM ed GROUP BY src)", "r0 AS (SELECT src AS node, 1.0::DOUBLE/(SELECT count(*) FROM dg) AS pr FROM dg)",
        *[step.format(i=i, j=i - 1) for i in range(1, steps + 1)],
    )


SQL = {
    "pair_tfidf": pairs_sql(
        "SELECT p.pair_id, " + ", ".join(f"round(coalesce({f}, 0), 6) AS tfidf_{n}{i}" if n != "len" else f"coalesce({f}, 0) AS tfidf_{n}{i}" for i in (1, 2) for n, f in (("sum", f"sum(wt) FILTER (side={i})"), ("mean", f"avg(wt) FILTER (side={i})"), ("len", f"count(wt) FILTER (side={i})"))) + " FROM pairs p LEFT JOIN u USING (pair_id) GROUP BY p.pair_id",
        TEXTS, *_weighted(f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOPS}, w))", True, 2),
    ),
    "pair_trigram_distances": _distances("trigram", chars("lower(text)", 3), TRIGRAM_KINDS),
    "question_ids": pairs_sql("SELECT question, min(loc) AS qid FROM (SELECT question1 AS question, 2*pair_id AS loc FROM pairs UNION ALL SELECT question2, 2*pair_id+1 FROM pairs) GROUP BY question"),
    "graph_frequency": pairs_sql("SELECT pair_id, f1.n AS q1_freq, f2.n AS q2_freq FROM pairs JOIN f f1 ON question1 IS NOT DISTINCT FROM f1.t JOIN f f2 ON question2 IS NOT DISTINCT FROM f2.t", "f AS (SELECT t, count(*) AS n FROM (SELECT question1 AS t FROM pairs UNION ALL SELECT question2 FROM pairs) GROUP BY t)"),
    "graph_common_neighbours": pairs_sql(
        "SELECT x.pair_id, coalesce(k, 0) AS q1_q2_intersect, round(coalesce(sw / nullif(t1.total + t2.total, 0), 0), 6) AS q1_q2_wm_ratio FROM x JOIN tt t1 ON x.a=t1.src JOIN tt t2 ON x.b=t2.src LEFT JOIN h USING (pair_id)",
        TEXTS, "ed AS (SELECT a AS src, b AS dst FROM x UNION SELECT b, a FROM x)", "dm AS (SELECT *, list_distinct(" + nostops("list_filter(string_split_regex(lower(src), '\\s+'), lambda w: w <> '')") + ") AS w1, list_distinct(" + nostops("list_filter(string_split_regex(lower(dst), '\\s+'), lambda w: w <> '')") + ") AS w2 FROM ed)",
        "g AS (SELECT src, dst, CASE WHEN len(w1)=0 OR len(w2)=0 THEN 0 ELSE " + div("2*len(list_intersect(w1,w2))", "len(w1)+len(w2)") + " END AS w FROM dm)", "tt AS (SELECT src, sum(w) AS total FROM g GROUP BY src)",
        "h AS (SELECT pair_id, count(*) AS k, sum(g1.w+g2.w) AS sw FROM x JOIN g g1 ON x.a=g1.src JOIN g g2 ON x.b=g2.src AND g1.dst=g2.dst GROUP BY pair_id)",
    ),
    "graph_pagerank": _pagerank(STEPS),
    "graph_pagerank_40": _pagerank(40),
    "graph_triangles": pairs_sql(
        "SELECT p.pair_id, count(h.n) AS triangles FROM pairs p LEFT JOIN h USING (pair_id) GROUP BY p.pair_id", f"ed AS (SELECT * FROM ({SIMPLE}) WHERE src <> dst)",
        "h AS (SELECT pair_id, e1.dst AS n FROM pairs JOIN ed e1 ON question1=e1.src JOIN ed e2 ON question2=e2.src AND e1.dst=e2.dst WHERE question1 <> question2)",
    ),
    "graph_small_cliques": pairs_sql(
        "SELECT pair_id, (CASE WHEN question1 = question2 THEN -1 ELSE coalesce(2 + k, 2) END)::BIGINT AS clique_to_4 FROM pairs LEFT JOIN z ON a=question1 AND b=question2", f"ed AS MATERIALIZED (SELECT * FROM ({SIMPLE}) WHERE src <> dst)",
        "t AS MATERIALIZED (SELECT e1.src AS a, e2.src AS b, e1.dst AS n FROM ed JOIN ed e1 ON e1.src=ed.src JOIN ed e2 ON e2.src=ed.dst AND e2.dst=e1.dst)",
        "z AS (SELECT t.a, t.b, max(CASE WHEN u.n IS NULL THEN 1 ELSE 2 END) AS k FROM t LEFT JOIN (SELECT t.a, t.b, t.n FROM t JOIN t o ON o.a=t.a AND o.b=t.b JOIN ed ON ed.src=t.n AND ed.dst=o.n) u ON u.a=t.a AND u.b=t.b AND u.n=t.n GROUP BY 1, 2)",
    ),
    "graph_subgraphs": (
        "WITH RECURSIVE " + pairs_sql("", f"ed AS ({SIMPLE})", "reach AS (SELECT src AS node, src AS other FROM ed UNION SELECT reach.node, ed.dst FROM reach JOIN ed ON reach.other=ed.src)", "cc AS (SELECT node, min(other) AS c FROM reach GROUP BY node)", "nn AS (SELECT c, count(*) AS subgraph_nodes FROM cc GROUP BY c)", "ee AS (SELECT c, count(*) AS subgraph_edges FROM ed JOIN cc ON src=node WHERE src < dst GROUP BY c)").removeprefix("WITH ")
        + "SELECT pair_id, subgraph_nodes, coalesce(subgraph_edges, 0) AS subgraph_edges FROM pairs JOIN cc ON question1=node JOIN nn USING (c) LEFT JOIN ee USING (c)"
    ),
    "sequence_vocabulary": pairs_sql("SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS word_id FROM v GROUP BY word", TEXTS, f"s AS ({UNPIVOT})", "v AS (SELECT pair_id, side, unnest(ww) AS word, generate_subscripts(ww, 1) AS loc FROM (SELECT pair_id, side, list_filter(string_split(regexp_replace(lower(text), '[!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~\\t\\n]', ' ', 'g'), ' '), lambda w: w <> '') AS ww FROM s))"),
    "folds": pairs_sql("SELECT pair_id, (('0x'||substr(md5(pair_id::VARCHAR||'2017'),17,8))::BIGINT % 5)::INT AS fold FROM pairs"),
    "stratified_folds": pairs_sql("SELECT pair_id, ((row_number() OVER (PARTITION BY is_duplicate ORDER BY ('0x'||substr(md5(pair_id::VARCHAR||'2017'),17,8))::BIGINT, pair_id) - 1) % 10)::INT AS fold FROM pairs"),
    "prior_shift": pairs_sql("SELECT pair_id, round(a*p/(a*p+b*(1-p)), 9) AS p FROM sc, (SELECT 0.174264424749::DOUBLE/0.369197853026 AS a, (1-0.174264424749::DOUBLE)/(1-0.369197853026) AS b)", SCORED),
    "class_weights": pairs_sql("SELECT pair_id, round(CASE WHEN is_duplicate=1 THEN 0.174264424749::DOUBLE/0.369197853026 ELSE (1-0.174264424749::DOUBLE)/(1-0.369197853026) END, 9) AS weight FROM pairs"),
    "prior_from_loss": pairs_sql("SELECT pair_id, round((-0.55::DOUBLE-ln(1-p))/(ln(p)-ln(1-p)), 6) AS rate FROM sc WHERE p > 0.001 AND p <> 0.5", SCORED),
    "metrics": pairs_sql(
        "SELECT round(ll, 6) AS log_loss, round(tp/nullif(tp+fp,0), 6) AS precision, round(tp/nullif(tp+fn,0), 6) AS recall, round(2*tp/nullif(2*tp+fp+fn,0), 6) AS f1, round(auc, 6) AS auc FROM m, u",
        SCORED, "m AS (SELECT -avg(is_duplicate*ln(q)+(1-is_duplicate)*ln(1-q)) AS ll, (sum(is_duplicate) FILTER (p>=0.5))::DOUBLE AS tp, (sum(1-is_duplicate) FILTER (p>=0.5))::DOUBLE AS fp, (sum(is_duplicate) FILTER (p<0.5))::DOUBLE AS fn FROM (SELECT *, least(greatest(p, 1e-15), 1-1e-15) AS q FROM sc))",
        "u AS (SELECT (sum(rk) FILTER (is_duplicate=1) - np*(np+1)/2) / (np*(n-np)) AS auc FROM (SELECT is_duplicate, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE)::DOUBLE AS rk FROM sc), (SELECT sum(is_duplicate)::DOUBLE AS np, count(*)::DOUBLE AS n FROM sc) GROUP BY np, n)",
    ),
    "score_correlation": pairs_sql("SELECT round(corr(p, q), 6) AS pearson FROM (SELECT p, p*p+is_duplicate AS q FROM sc)", SCORED),
    "standardised": pairs_sql("SELECT pair_id, round((l1-avg(l1) OVER ())/stddev_samp(l1) OVER (), 6) AS l1, round((l2-avg(l2) OVER ())/stddev_samp(l2) OVER (), 6) AS l2 FROM (SELECT pair_id, length(a)::DOUBLE AS l1, length(b)::DOUBLE AS l2 FROM x)", TEXTS),
    "fold_average": pairs_sql("SELECT pair_id, round(avg(p), 9) AS p FROM (SELECT pair_id, p FROM sc UNION ALL SELECT pair_id, p*p FROM sc UNION ALL SELECT pair_id, sqrt(p) FROM sc) GROUP BY pair_id", SCORED),
    "implied_labels": pairs_sql(
        "SELECT a, b, min(y1*y2) AS label FROM (SELECT l.a, r.b, l.y AS y1, r.y AS y2 FROM bo l JOIN bo r ON l.b=r.a) WHERE a < b AND y1+y2 > 0 AND (a, b) NOT IN (SELECT (a, b) FROM bo) GROUP BY a, b",
        "bo AS (SELECT question1 AS a, question2 AS b, is_duplicate AS y FROM pairs WHERE question1 <> question2 UNION SELECT question2, question1, is_duplicate FROM pairs WHERE question1 <> question2)",
    ),
    "vector_distances": (
        "WITH v AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1), u AS (SELECT vec_id, unnest(x) AS x, unnest(y) AS y FROM v) "
        "SELECT vec_id, round(1-sum(x*y)/(sqrt(sum(x*x))*sqrt(sum(y*y))), 6) AS cosine_distance, round(sum(abs(x-y)), 6) AS cityblock_distance, round(sum((x<>y)::INT)::DOUBLE/sum((x<>0 OR y<>0)::INT), 6) AS jaccard_distance, round(sum(coalesce(abs(x-y)/nullif(abs(x)+abs(y),0),0)), 6) AS canberra_distance, "
        "round(sqrt(sum((x-y)*(x-y))), 6) AS euclidean_distance, round(pow(sum(pow(abs(x-y),3)), 1.0::DOUBLE/3), 6) AS minkowski_distance, round(sum(abs(x-y))/sum(abs(x+y)), 6) AS braycurtis_distance, "
        "round((sum(x*x*x)/64-3*avg(x)*sum(x*x)/64+2*pow(avg(x),3))/pow(sum(x*x)/64-avg(x)*avg(x),1.5), 6) AS skew, round(kurtosis_pop(x), 6) AS kur FROM u GROUP BY vec_id"
    ),
}
SQL["pair_lemma_distances"] = _distances("lemma", f"list_filter({tokens('text')}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))", LEMMA_KINDS)
SQL["sequence_encode"] = pairs_sql(
    "SELECT p.pair_id, array_to_string(" + "), array_to_string(".join(f"list_concat(list_transform(range(0, 40-least(coalesce(len(l{i}),0),40)), lambda i: 0::BIGINT), coalesce(list_slice(l{i}, greatest(len(l{i})-39, 1), len(l{i})), [])), ' ') AS ids{i}" for i in (1, 2)).replace("), array_to_string(", ", array_to_string(") + " FROM pairs p LEFT JOIN ll USING (pair_id)",
    TEXTS, f"s AS ({UNPIVOT})", SQL["sequence_vocabulary"][SQL["sequence_vocabulary"].index("v AS ("):SQL["sequence_vocabulary"].rindex("\n")],
    "vv AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS word_id FROM v GROUP BY word)", "ll AS (SELECT pair_id, list(word_id ORDER BY loc) FILTER (side=1) AS l1, list(word_id ORDER BY loc) FILTER (side=2) AS l2 FROM v JOIN vv USING (word) GROUP BY pair_id)",
)
_VEC = "(('0x'||substr(md5(word),17,8))::BIGINT % (SELECT count(*) FROM embeddings))"
SQL["pair_embedding"] = pairs_sql(
    "SELECT p.pair_id, " + "round(coalesce(1-dot, NULL), 5) AS emb_cosine_distance, round(coalesce(l1, 0), 4) AS emb_cityblock_distance, round(coalesce(l2, 0), 5) AS emb_euclidean_distance FROM pairs p LEFT JOIN dd USING (pair_id)",
    TEXTS, f"s AS ({UNPIVOT})", f"wd AS (SELECT pair_id, side, unnest(list_filter({nostops(tokens('text'))}, lambda w: regexp_matches(w, '^\\p{{L}}+$'))) AS word FROM s)",
    "ve AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)", f"wv AS MATERIALIZED (SELECT pair_id, side, {_VEC} AS vid FROM wd)", "sv AS (SELECT pair_id, side, i, sum(v) AS v FROM wv JOIN ve ON vec_id=vid GROUP BY ALL)",
    "nv AS (SELECT pair_id, side, i, v/sqrt(sum(v*v) OVER (PARTITION BY pair_id, side)) AS v FROM sv)",
    "dd AS (SELECT pair_id, CASE WHEN max(f.v) IS NULL OR max(g.v) IS NULL THEN NULL ELSE sum(coalesce(f.v,0)*coalesce(g.v,0)) END AS dot, sum(abs(coalesce(f.v,0)-coalesce(g.v,0))) AS l1, sqrt(sum((coalesce(f.v,0)-coalesce(g.v,0))*(coalesce(f.v,0)-coalesce(g.v,0)))) AS l2 FROM (SELECT * FROM nv WHERE side=1) f FULL JOIN (SELECT * FROM nv WHERE side=2) g USING (pair_id, i) GROUP BY pair_id)",
)


def _round(i: int, edge: str, change: str, limit: str) -> tuple[str, str]:
    return (
        f"g{i} AS (SELECT question1 AS src, question2 AS dst FROM k{i - 1} WHERE {edge} UNION SELECT question2, question1 FROM k{i - 1} WHERE {edge})",
        f"k{i} AS (SELECT pair_id, question1, question2, split, is_duplicate, CASE WHEN split='test' AND {limit} AND EXISTS (SELECT 1 FROM g{i} a JOIN g{i} b ON a.dst=b.dst WHERE a.src=question1 AND b.src=question2) THEN {change} ELSE p END AS p FROM k{i - 1})",
    )


_UP = ("(split='train' AND is_duplicate=1) OR (split='test' AND p>0.5)", "p+least(0.2,(0.98-p)/2)", "p<0.98")
_DOWN = ("(split='train' AND is_duplicate=0) OR (split='test' AND p<0.1)", "p-least(0.2,(p-0.01)/2)", "p>0.01")
SQL["transitivity"] = pairs_sql("SELECT pair_id, round(p, 9) AS p FROM k4 WHERE split='test'", SCORED, "k0 AS (SELECT * FROM sc)", *_round(1, *_UP), *_round(2, *_UP), *_round(3, *_DOWN), *_round(4, *_DOWN))
SQL["question_dense_ids"] = pairs_sql("SELECT question, row_number() OVER (ORDER BY min(loc)) - 1 AS qid FROM (SELECT question1 AS question, 2*pair_id AS loc FROM pairs UNION ALL SELECT question2, 2*pair_id+1 FROM pairs) GROUP BY question")
SQL["term_totals"] = pairs_sql("SELECT term, count(*) AS total FROM (SELECT unnest(list_filter(string_split_regex(lower(t), '\\s+'), lambda w: w <> '')) AS term FROM (SELECT coalesce(question1, '') AS t FROM pairs UNION ALL SELECT coalesce(question2, '') FROM pairs)) GROUP BY term")
# the weight at which the mean of the moved scores is the target, by bisection
_MOVED = "w*p/(w*p+(1-w)*(1-p))"
SQL["mean_matching"] = pairs_sql(
    f"SELECT pair_id, round({_MOVED}, 6) AS p FROM sc, (SELECT (lo+hi)/2 AS w FROM bs WHERE i=48)",
    SCORED, "bs AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL SELECT i+1, CASE WHEN m<0.3 THEN w ELSE lo END, CASE WHEN m<0.3 THEN hi ELSE w END FROM "
    f"(SELECT i, lo, hi, w, avg({_MOVED}) AS m FROM (SELECT i, lo, hi, (lo+hi)/2 AS w FROM bs WHERE i<48), sc GROUP BY ALL))",
)
SQL["oversampled"] = pairs_sql(
    "SELECT pair_id, is_duplicate, unnest(range(1, c+1))::INT AS copy FROM (SELECT pair_id, is_duplicate, CASE WHEN is_duplicate=0 THEN greatest(floor(times+(('0x'||substr(md5(pair_id||':2017'),17,8))::BIGINT % 1000000)/1000000.0::DOUBLE)::INT, 1) ELSE 1 END AS c FROM tr, nt)",
    "tr AS (SELECT * FROM pairs WHERE split='train')", "nt AS (SELECT greatest(1.0::DOUBLE, sum((is_duplicate=1)::INT)*(1-0.05::DOUBLE)/0.05::DOUBLE/greatest(1, sum((is_duplicate=0)::INT))) AS times FROM tr)",
)
SQL["mean_matching"] = SQL["mean_matching"].replace("WITH ", "WITH RECURSIVE ", 1)
SQL["pair_surface"] = pairs_sql(
    "SELECT pair_id, " + ", ".join(f"least(len(list_filter({x}, lambda w: regexp_matches(w, '^\\p{{Lu}}') AND NOT list_contains(list_transform({y}, lambda v: lower(v)), lower(w)))), 3)::INT AS {n}_unmatch_ner" for x, y, n in (("s", "t", "S"), ("t", "s", "T"))) + f", abs(len(s)-len(t))::INT AS len_dif, round({div('2*abs(len(s)-len(t))', 'len(s)+len(t)')}, 6) AS len_dif_p FROM y",
    "y AS (SELECT pair_id, " + tokens("coalesce(question1, 'Null')", False) + " AS s, " + tokens("coalesce(question2, 'Null')", False) + " AS t FROM pairs)",
)
