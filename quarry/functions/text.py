"""Text functions as column expressions: tokenisers, normalisers, counts and cuts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the two lexical retrievers and of the episodic store. They differ on purpose.
BM25_STOPWORDS = (
    "a an and are as at be been being by did do does doing for from had has have having he her him his i if in into is it its itself just "
    "me my of on or our she so than that the their them then there these they this those to up us was we were what when where which who "
    "will with would you your"
).split()
SUBSTRING_STOPWORDS = (
    "a an and are as at be been by did do does for from had has have he her him his i if in is it its just me my of on or she so than that "
    "the their them then there they this those to us was we were what when where which who will with would you your"
).split()
EPISODIC_STOPWORDS = (
    "a an and are as at be by did do for from had has have how in is it its of on or that the their them there to was were what when where "
    "which who with would"
).split()
GREP_STOPWORDS = "the and for with that this from what which when where who why how was were are is did does have has into about using only answer".split()
# Fixed value: ASCII punctuation, as deleted by the first normaliser.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    """Lower-case tokens that match a pattern."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(stop))


def counted(tokens: Column) -> Column:
    """Each token with how often it stands (term, tf): run lengths of the sorted tokens, within the row."""
    starts = lambda s: F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)), lambda i: i.isNotNull())
    runs = lambda s, at: F.transform(at, lambda a, k: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - a).cast("long").alias("tf")))
    return let(F.array_sort(tokens), lambda s: let(starts(s), lambda at: runs(s, at)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def terms(text: Column, stop: list[str] | None = None) -> Column:
    """Tokens for lexical ranking; none at all count as one empty token."""
    found = words(text) if stop is None else without(words(text), stop)
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def keywords(text: Column) -> Column:
    """Content words of a query, of two letters or more; repeats stay."""
    return F.filter(without(words(text), SUBSTRING_STOPWORDS), lambda t: F.length(t) >= 2)


def split_words(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+"), lambda t: t != "")


def normalise(text: Column) -> Column:
    """Lower case, articles out, ASCII punctuation deleted, white space collapsed, in that order."""
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(F.translate(t, PUNCTUATION, ""), r"\s+", " "))


def normalise_spaced(text: Column) -> Column:
    """Lower case, what is no letter, digit, underscore or space becomes a space, then articles out."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def answer_words(text: Column) -> Column:
    """Tokens of the first normaliser."""
    return F.filter(F.split(normalise(text), " "), lambda t: t != "")


def table_words(text: Column) -> Column:
    """Tokens of the results table: full stop, comma, exclamation and question mark are spaces."""
    return F.filter(F.split(F.lower(F.translate(F.coalesce(text, F.lit("")), ".,!?", "    ")), r"\s+"), lambda t: t != "")


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text without overlap."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def cut_middle(text: Column, limit: int, marker: str = "\n...[truncated]...\n") -> Column:
    """At most ``limit`` characters of a text: its halves around a marker."""
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, half), F.lit(marker), F.right(text, F.lit(limit - half)))).otherwise(text)


def cut_end(text: Column, limit: int, marker: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit(marker))).otherwise(text)


def token_estimate(text: Column, rule: str = "ceil") -> Column:
    """A text's tokens at four characters each: ``ceil``, ``floor``, at least one (``least``), or white-space ``words``."""
    n = F.length(F.coalesce(text, F.lit("")))
    if rule == "words":
        return F.size(split_words(text)).cast("long")
    quarter = F.ceil(n / 4).cast("long") if rule in ("ceil", "least") else F.floor(n / 4).cast("long")
    return F.greatest(F.lit(1).cast("long"), quarter) if rule == "least" else quarter


def html_text(html: Column, limit: int = 200_000) -> Column:
    """A page's visible text: scripts and styles out, tags out, white space collapsed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, limit)
