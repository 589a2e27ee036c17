"""Token, n-gram and set expressions over question texts; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def q_text(q: Column | str, null_as: str = "nan") -> Column:
    """The question with null replaced; each feature family names its own replacement."""
    return F.coalesce(F.col(q) if isinstance(q, str) else q, F.lit(null_as))


def split_words(text: Column) -> Column:
    """Lower-case words between white space, without empty ones."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def tokenize(text: Column, lower: bool = True) -> Column:
    """Runs of letters and digits, and every other visible character by itself."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(f"({TOKEN_PATTERN})"), 1)


#: Rules that part words from what is joined to them, in order: quotes, marks, possessives and contractions.
CONTRACTION_RULES = (
    (r"^\"|([ (\[{<])\"", "$1 `` "), (r"\"", " '' "), (r"([,;:@#$%&?!()\[\]{}<>]|\.\.\.|--)", " $1 "), (r"\.(['\")\]}]*)\s*$", " .$1 "),
    (r"(?i)([^' ])'(s|m|d|ll|re|ve) ", "$1 '$2 "), (r"(?i)([^' ])n't ", "$1 n't "), (r"([^' ])' ", "$1 ' "), (r"(?i)\b(can)(not)\b", "$1 $2"), (r"(?i)\b(gon|wan)(na)\b", "$1 $2"), (r"(?i)\b(got)(ta)\b", "$1 $2"), (r"(?i)\b(gim|lem)(me)\b", "$1 $2"),
)


def contraction_tokens(text: Column, lower: bool = True) -> Column:
    """Tokens with contractions parted as in treebanks: do + n't, it + 's, can + not; a full stop is a token at the end only."""
    out = F.concat(F.lit(" "), F.regexp_replace(F.lower(text) if lower else text, r"\s+", " "), F.lit(" "))
    for pattern, into in CONTRACTION_RULES:
        out = F.regexp_replace(out, pattern, into)
    return F.filter(F.split(out, r"\s+"), lambda w: w != "")


def without_stops(tokens: Column) -> Column:
    """Tokens that are no stop words; repeats stay."""
    return F.filter(tokens, lambda w: ~w.isin(STOPWORDS))  # a hashed set, not a walk along the list


def only_stops(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: w.isin(STOPWORDS))


def ngrams(tokens: Column, n: int, by: str = " ") -> Column:
    """Adjacent n-grams joined by a separator; none where there are fewer tokens."""
    parts = lambda i: F.concat_ws(by, *[F.element_at(tokens, i + k) for k in range(n)])
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), parts)).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, n: int) -> Column:
    size = F.length(text)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def common(a: Column, b: Column) -> Column:
    """Number of distinct elements that both arrays hold."""
    return F.size(F.array_intersect(a, b))


def ratio(x: Column, y: Column) -> Column:
    """x / y; null where y is 0."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def ratio_or_zero(x: Column, y: Column) -> Column:
    return F.coalesce(ratio(x, y), F.lit(0.0))
