"""Main text of web pages by equivalence-class template deduction.

Tokens are element paths (tag with classes, from the root). The occurrence vector of a token
over the pages of a host, its count on each page, is hashed with order-free sums, so tokens with
equal vectors meet in one pre-aggregated pass whatever the size of the host. A class of tokens
with one vector is valid if it is on enough pages and nests: above its tokens lies one other valid
class, or none. The nested valid classes are the template; the blocks of text at their paths fill
its slots. The article is an element that a valid class has once on each of its pages: the outermost one that is
named so by its tag and holds most of the text that varies, or else the deepest one that holds
nearly all of it; an element holds the different texts of all blocks below it, however rare their own paths are. Pages are cut to that element; blocks in elements that are never article text (menus, forms,
adverts, comments by tag, role and class) go wherever they are. Pages without the template's article are
cut by such elements alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialize, tidy

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
UNENDED = re.compile(r"<[!?]")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Elements without an end, those whose content is no markup, those that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements, roles and class or id words that are never the article.
NOT_TEXT = frozenset("head script style noscript template svg iframe object canvas button select option textarea input form nav footer aside menu dialog".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets related recommended share sharing social footer masthead comment comments disqus reply replies login signup register subscribe subscription newsletter pagination pager toolbar skip".split()
)
ARTICLES = frozenset(("article", "main"))
TITLES = frozenset("h1 h2".split())
# Share of a host's pages that a class must be on to be valid; shares of the varying text that the article holds, if
# its tag names it and if not.
VALID, NAMED_SHARE, ARTICLE_SHARE = 0.5, 0.5, 0.7
# Elements below this depth count to the path of the one at it; longer labels are hashed. No text is lost by either.
MAX_DEPTH, MAX_LABEL = 200, 300


def blocks_of(page: str) -> tuple[dict[str, int], list[tuple[str, bool, str]]]:
    """Element path -> count, and (path, excluded by its elements, text) of each text block in order."""
    counts: dict[str, int] = {}
    out: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, str, bool]] = [("", "", False)]  # tag, path, excluded
    held: list[str] = []
    where: list[tuple[str, bool]] = []  # of the first text of the block

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((*where[0], text))
            held.clear()
            where.clear()

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            if not where and text.strip():
                where.append(stack[-1][1:])
            if where:
                held.append(text)

    at, size, last = 0, len(page), page.rfind(">")
    open_: Counter[str] = Counter()  # tags of the stack

    def close(depth: int) -> None:
        open_.subtract(s[0] for s in stack[depth:])
        del stack[depth:]

    while at < size:
        m = MARKUP.search(page, at) if at <= last else None
        if m is None:  # no tag ends any more
            add(UNENDED.split(page[at:], maxsplit=1)[0])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag closes up to its element, if that is open
            if tag in BLOCKS:
                flush()
            if open_[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            elif tag == "p" or tag == "br":
                add(" ")
            continue
        if tag in BLOCKS:
            flush()
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
            if any(open_[t] > 0 for t in ("p", *closes)):
                for i in range(len(stack) - 1, 0, -1):  # an open p, or an item of the same list, ends here
                    if stack[i][0] == "p" or stack[i][0] in closes:
                        close(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
        attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m[3])} if m[3] else {}
        names = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()) if attrs else []
        path = path_below(stack[-1][1], tag, attrs.get("class", ""), len(stack))
        hidden = bool(m[3]) and (re.search(r"(?:^|\s)hidden(?:\s|=|$)", m[3]) is not None or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""))
        inside = any(open_[t] > 0 for t in ARTICLES)
        bad = stack[-1][2] or tag in NOT_TEXT or hidden or attrs.get("role", "").lower() in NOT_ROLES or (tag not in ("html", "body", *ARTICLES) and not NOT_WORDS.isdisjoint(names)) or (tag == "header" and not inside)
        counts[path] = counts.get(path, 0) + 1
        if tag == "br":
            add(" ")
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = raw_end(tag).search(page, at)
            at = end.end() if end else size
            continue
        stack.append((tag, path, bad))
        open_[tag] += 1
    flush()
    return counts, out


def path_below(above: str, tag: str, classes: str, depth: int) -> str:
    """The path of an element below another: its tag and sorted classes, with digits as 0 and without the slash of paths."""
    if depth > MAX_DEPTH:
        return above
    label = tag + "".join(f".{n}" for n in sorted(set(re.sub(r"\d+", "0", classes.lower()).replace("/", "\u2215").split())))
    return f"{above}/{label if len(label) <= MAX_LABEL else f'{tag[:MAX_LABEL]}.{_hash(label)}'}"


@cache
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


@lru_cache(1 << 14)
def places_above(path: str) -> list[int]:
    """Hashes of the path itself, of those of all elements above it, and of '' for the page."""
    out = [_hash(path)]
    while path:
        path = path.rpartition("/")[0]
        out.append(_hash(path))
    return out


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def nested_classes(tokens: dict[str, tuple]) -> dict[str, tuple]:
    """path -> occurrence vector of the tokens in the template: those of valid classes that nest.

    tokens: path -> vector, any value that is equal for equal vectors. A class nests if the lowest
    elements above its tokens that are not its own all lie in one class that nests, or there are none.
    """
    classes: dict[tuple, list[str]] = {}
    for path, vector in tokens.items():
        classes.setdefault(vector, []).append(path)
    above: dict[tuple, tuple | None] = {}  # class -> the class that it lies in; missing where it lies in several
    for vector, paths in classes.items():
        found = set()
        for path in paths:
            up = path.rpartition("/")[0]
            while up and tokens.get(up) == vector:
                up = up.rpartition("/")[0]
            found.add(tokens.get(up, ("rare", up)) if up else None)
        found.discard(None)
        if len(found) <= 1:
            above[vector] = next(iter(found), None)
    template = {}
    for vector, paths in classes.items():
        seen, at = set(), vector
        while at is not None and at in above and at not in seen:
            seen.add(at)
            at = above[at]
        if at is None:
            template.update((p, vector) for p in paths)
    return template


def article_of(tokens: dict[str, tuple], pages: int, varied: dict[str, int]) -> str | None:
    """The path of the article in a host's template.

    tokens: vectors (hashes, support, total) of the paths; varied: the characters of the different texts that
    are below a path, '' being the page.
    """
    template = nested_classes({p: v for p, v in tokens.items() if v[-2] >= VALID * pages})
    total = varied.get("", 0)
    share = lambda path: varied.get(path, 0) / total if total else 0.0
    once = sorted((p for p, v in template.items() if v[-1] == v[-2]), key=lambda p: (p.count("/"), p))
    for p in once:
        if p.rpartition("/")[2].split(".")[0] in ARTICLES and share(p) >= NAMED_SHARE:
            return p
    best = None
    for p in once:
        if (best is None or p.startswith(best + "/")) and share(p) >= ARTICLE_SHARE:
            best = p
    return best


def deduce(tokens: pd.DataFrame) -> pd.DataFrame:
    """(host, article) of one host from its tokens: (path, fp1, fp2, support, total, varied, pages, all_chars)."""
    vectors = {p: tuple(v) for p, *v in tokens[["path", "fp1", "fp2", "support", "total"]].itertuples(index=False)}
    varied = dict(zip(tokens["path"], tokens["varied"].tolist(), strict=True)) | {"": int(tokens["all_chars"].iloc[0])}
    return pd.DataFrame({"host": [tokens["host"].iloc[0]], "article": [article_of(vectors, int(tokens["pages"].iloc[0]), varied)]})


ELEMENTS = pa.schema([("host", pa.string()), ("path", pa.string()), *[(n, pa.int64()) for n in ("place", "occurrence", "n", "said")]])


def templates(pages: DataFrame, key: str, html_column: str) -> DataFrame:
    """(host, article path or null) from pages with a host column; one row a host."""

    @tidy
    def tokens(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[tuple] = []
            said: dict[tuple, int] = {}
            for k, host, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts, blocks = blocks_of(x.as_py() or "")
                rows += [(host, path, _hash(path), _hash(k, n), n, None) for path, n in counts.items()]
                for path, bad, text in blocks:
                    if not bad:
                        h = _hash(text)
                        for p in places_above(path):
                            said[host, p, h] = len(text)
            rows += [(host, None, p, None, n, h) for (host, p, h), n in said.items()]
            columns = zip(*rows, strict=True) if rows else [()] * len(ELEMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ELEMENTS, strict=True)], schema=ELEMENTS)

    found = pages.select(F.col(key).alias("k"), "host", F.col(html_column).alias("h")).mapInArrow(tokens, "host string, path string, place bigint, occurrence bigint, n bigint, said bigint")
    # one pass: element counts have a path, texts a hash; both are summed before they are shuffled
    summed = materialize(
        found.groupBy("host", "place", "said").agg(
            F.first("path", ignorenulls=True).alias("path"),
            # sums of 32 bits each can't overflow, and a page that is there twice counts twice for all its tokens
            F.sum(F.col("occurrence").bitwiseAND(0xFFFFFFFF)).alias("fp1"), F.sum(F.shiftrightunsigned("occurrence", 32)).alias("fp2"),
            F.count("occurrence").alias("support"), F.sum("n").alias("total"), F.max("n").alias("chars"),
        ), "elements",
    )
    texts = summed.filter("said is not null").groupBy("host", "place").agg(F.sum("chars").alias("varied"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # only elements on VALID of the pages can be in a template: at most the elements of a page / VALID a host
    kept = summed.filter("said is null").join(sizes, "host").filter(F.col("support") >= VALID * F.col("pages"))
    whole = texts.filter(F.col("place") == _hash("")).select("host", F.col("varied").alias("all_chars"))
    known = kept.join(texts, ["host", "place"], "left").join(whole, "host", "left").na.fill(0, ["varied", "all_chars"])
    return known.select("host", "path", "fp1", "fp2", "support", "total", "varied", "pages", "all_chars").groupBy("host").applyInPandas(deduce, "host string, article string")


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of every page.

    Blocks of the article are joined in page order by two newlines; white space inside a block
    is one space; character references are decoded. Null and empty pages, and pages without
    an article, have an empty text. Pages that don't follow their host's template are cut by their
    elements alone; the rules are the same for hosts of one page and of any number. Null
    urls, and urls without a host, share one host. Repeated rows are extracted each; an empty table gives no
    rows; other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    hosted = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html_column).alias("h"), host.alias("host"))
    # written first, so that Spark knows its size when it picks the join; a path a host
    deduced = materialize(templates(hosted, "k", "h").filter("article is not null"), "templates")

    @tidy
    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = ["\n\n".join(main_blocks(x.as_py() or "", article)) for x, article in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "u", "text", "n_chars"])

    joined = hosted.join(deduced, "host", "left").select("k", "u", "h", "article")
    kind = dict(pages.dtypes)[key]
    return joined.mapInArrow(extract, f"k {kind}, u string, text string, n_chars bigint").withColumnsRenamed({"k": key, "u": url})


def main_blocks(page: str, article: str | None) -> list[str]:
    """Texts of the blocks in the template's article, or, without it, in the elements that name themselves so, or in all."""
    left = [(path, text) for path, bad, text in blocks_of(page)[1] if not bad]
    tag = lambda path: path.rpartition("/")[2].split(".")[0]
    if article is not None and any(p == article or p.startswith(article + "/") for p, _ in left):
        # a title above an article that is not named by its tag belongs to it
        named, above, begun, out = tag(article) in ARTICLES, article.rpartition("/")[0], False, []
        for p, t in left:
            inside = p == article or p.startswith(article + "/")
            begun |= inside
            if inside or not named and not begun and tag(p) in TITLES and p.startswith(above + "/"):
                out.append(t)
        return out
    marked = [t for p, t in left if any(s.split(".")[0] in ARTICLES for s in p.split("/"))]
    return marked or [t for _, t in left]
