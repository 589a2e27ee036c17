"""Corpus statistics and license scans against plain Python, with odd rows, small buffers and small blocks."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from pairloom.llm import collocations, divergence, licenses, words

DOCS = "doc_id bigint, text string, lang string, source string"
LOW = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)


def plain_divergence(docs, min_docs, top):
    """docs: (lang, source, text) without nulls."""
    count, inside = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", LOW(text))
        count[lang, source].update(found)
        inside[lang].update(set(found))
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in inside[lang].items() if n >= min_docs)
        groups = {s: c for (own, s), c in count.items() if own == lang}
        whole = sum(groups.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(rows, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked[:most], 1)]
    return sorted(out)


def plain_collocations(docs, least, top, most_words=3):
    """docs: (lang, text) without nulls."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", LOW(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = {p[i : i + k] for p, a in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 50 * counts[p[i : i + k]]}
        rows = []
        for p, a in good.items():
            if p not in held:
                score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def plain_licenses(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES, threshold=licenses.THRESHOLD):
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOW(t))
    w = found(text)
    places = [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    more, best = set(), 0.0
    for line in text.split("\n"):
        x = found(line)
        starts = [0] if len(x) <= licenses.BLOCK else range(0, len(x) - licenses.BLOCK + licenses.STRIDE, licenses.STRIDE)
        for at in starts if x else []:
            block = set(x[at : at + licenses.BLOCK])
            for label, template in templates:
                tokens = set(found(template))
                if tokens and 100 * len(tokens & block) >= threshold * len(tokens):
                    more.add(label)
                    best = max(best, len(tokens & block) / len(tokens))
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else best


def odd_docs(rng, size):
    vocabulary = ["the", "The", "of", "été", "ÉTÉ", "naïve", "k\u212a", "x1y", "a-b", "ab\x00cd", "\u3000", "end.", "no,", "yes!\n", "tab\t", "\x0b", "\x0c", "\r\n", "", "z" * 30]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))
    rows = [(i, rng.choice([None, "", text(), text(), text()]), rng.choice([None, "", "en", "fr", "und"]), rng.choice([None, "", "s1", "s2", "é", "z"])) for i in range(size)]
    return rows + rows[:5] + [(None, "the of the of", "en", "s1"), (size, "the of. " * 3000, "en", "s9"), (size + 1, "12 34", "xx", "one"), (size + 2, None, "yy", "a"), (size + 3, "", "yy", "b")]


@pytest.fixture
def small_buffers(monkeypatch):
    monkeypatch.setattr(words, "SLICE", 50)


def test_slices_cut_at_spaces():
    rng = random.Random(1)
    for size in (1, 3, 10, 1000):
        text = bytes(rng.choice(b"ab \xff") for _ in range(300))
        parts = list(words.slices(text, size))
        assert b"".join(parts) == text and all(p[-1:] in b" \xff" for p in parts[:-1])
    assert list(words.slices(b"x" * 5000, 100)) == [b"x" * 5000] and list(words.slices(b"", 9)) == []


@pytest.mark.parametrize("block, top", [(256, 10), (2, 3)])
def test_divergence_of_odd_rows(spark, block, top):
    rows = odd_docs(random.Random(2), 150)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    more = df.selectExpr("*", "1 as body", "2 as term", "3 as n", "4 as whole", "5 as rank")
    got = sorted(map(tuple, divergence.source_divergence(more, min_docs=3, top_terms=top, block=block).collect()))
    assert got == plain_divergence([(x or "", s or "", t or "") for _, t, x, s in rows], 3, top)
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_over_batch_ends(spark):
    """Kept terms and sweeps carry an open run over the ends of batches of a few rows."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(12)), "en", f"s{rng.randrange(7)}") for i in range(120)]
    df = spark.createDataFrame(rows, DOCS).repartition(9)
    want = plain_divergence([(x, s, t) for _, t, x, s in rows], 10, 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, divergence.source_divergence(df).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_counts_stay_exact():
    import numpy as np

    p = np.array([1, 10**9 + 1, 999_999_937], np.int64)
    assert [int(divergence.divergence(a, b)) for a, b in itertools.product(p, p)] == [int(a - b) ** 2 // int(a + b) for a, b in itertools.product(map(int, p), map(int, p))]


@pytest.mark.parametrize("buffer", [5, 1000])
def test_collocations_of_odd_rows(spark, buffer):
    rows = odd_docs(random.Random(4), 120)
    docs = [(x if x is not None else "und", t or "") for _, t, x, _ in rows]
    slim = spark.createDataFrame(docs, "lang string, body string").selectExpr("lang", "cast(body as binary) body")

    def small(batches):  # counts of small buffers add up to those of large ones
        collocations.BUFFER, words.SLICE = buffer, 40
        yield from batches

    counts = Counter()
    for r in collocations.gram_rows(slim.repartition(3).mapInArrow(small, "lang string, body binary"), range(1, 4)).collect():
        counts[r["lang"], r["phrase"]] += r["f"]
    want = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", LOW(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want[lang, ""] += len(w)
            want.update((lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert +counts == +want


def test_long_texts_are_counted_over_several_buffers():
    from pairloom.llm.words import Numbers

    rng = random.Random(5)
    stream = [rng.choice(["a", "b", "c", None]) for _ in range(400)]
    numbers = Numbers({b"\xff": 0})
    ids = [0 if w is None else numbers[w.encode()] for w in stream]
    import numpy as np

    whole, parts = Counter(), Counter()
    table = [k if k != b"\xff" else b"" for k in numbers]
    for batch in collocations.gram_counts("x", np.array(ids), 0, table, range(1, 4)):
        whole.update(dict(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))
    for at in range(0, 400, 7):
        lead = min(at, 2)
        for batch in collocations.gram_counts("x", np.array(ids[at - lead : at + 7]), lead, table, range(1, 4)):
            parts.update(dict(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))
    assert +whole == +parts


@pytest.mark.parametrize("most", [2, 3, 5])
def test_ranked_collocations(spark, most):
    rng = random.Random(6)
    rows = [(i, ". ".join(" ".join(rng.choice(["new", "york", "city", "in", "the", "é"]) for _ in range(rng.randrange(1, 8))) for _ in range(9)), rng.choice(["en", None]), "s") for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as phrase", "2 as f", "3 as rank")
    got = sorted(map(tuple, collocations.mine_collocations(df, max_words=most, min_count=3, top=25).collect()))
    assert got == plain_collocations([(x or "und", t) for _, t, x, _ in rows], 3, 25, most) and len(got) > 20
    assert collocations.mine_collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_licenses_of_odd_rows(spark):
    rng = random.Random(7)
    parts = [t for _, t in licenses.TEMPLATES] + ["cc by nc cc by nc", "UNDER the\tMIT--License", "apache license version 2", "x under the mit licenses", "İunder the mit license", "under the mit license5", "word " * 120, "\n", "\n", "été ", ". "]
    texts = [" ".join(rng.sample(parts, rng.randrange(5))) for _ in range(150)]
    for _, template in licenses.TEMPLATES:  # near and far variants of each template
        w = template.split()
        texts += [" ".join(rng.sample(w, len(w) - k)) for k in (0, 1, 2, 4) if k < len(w)] + ["filler " * 90 + template + " filler" * 70]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (3, "other", "en", "s"), (None, None, None, None), (None, "cc by nc", None, None), (900, "", "en", "s")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as words", "2 as row", "3 as labels", "4 as places")
    got = sorted(map(repr, (tuple(r) for r in licenses.scan_licenses(df).collect())))
    assert got == sorted(repr((r[0], *plain_licenses(r[1] or ""))) for r in rows)
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_license_parameters(spark):
    rows = [(0, "Do what you want, with this thing", "en", "s"), (1, "nothing here", "en", "s")]
    df = spark.createDataFrame(rows, DOCS)
    templates = [("free", "do what you want with it"), ("free", "do what you want with it"), ("none", "..."), ("word", "nothing")]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan_licenses(df, templates=licenses.template_table(spark, templates), phrases={"this thing": "b"}, threshold=80).collect()}
    assert got == {k: plain_licenses(t, templates, {"this thing": "b"}, 80) for k, t, _, _ in rows}
    assert got[0][5] == "b,free" and got[1][5] == "word"
    none = licenses.scan_licenses(df, templates=licenses.template_table(spark, []), phrases={})
    assert [r["labels"] for r in none.collect()] == ["", ""]
