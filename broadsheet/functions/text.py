"""Column functions for titles, texts and labels."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonempty(c: Column | str) -> Column:
    """True for values that are neither NULL nor the empty string."""
    return _column(c).isNotNull() & (_column(c) != "")


def or_default(c: Column | str, default: str) -> Column:
    """The value, or `default` where it is NULL or empty."""
    return F.coalesce(F.nullif(_column(c), F.lit("")), F.lit(default))


def article_id(title: Column | str, source: Column | str) -> Column:
    """Stable id of an article: md5 of title and source."""
    return F.md5(F.concat(_column(title), F.lit("_"), _column(source)))


def first_category(categories: Column | str, requested: Column | str) -> Column:
    """First delivered category, else the one that was asked for."""
    return F.coalesce(F.get(_column(categories), 0), _column(requested))


def index_text(title="title", description="description", content="content") -> Column:
    """The text that is chunked and searched."""
    return _joined(". ", title, description, content)


def sentiment_text(title="title", description="description") -> Column:
    """The text that the lexicons are applied to."""
    return _joined(" ", title, description)


def full_text(title="title", description="description", content="content") -> Column:
    """The text that the preprocessing report reads."""
    return _joined(" ", title, description, content)


def _joined(separator: str, *columns: Column | str) -> Column:
    return F.concat_ws(separator, *[F.coalesce(_column(c), F.lit("")) for c in columns])


def strip_html(c: Column | str) -> Column:
    return F.regexp_replace(_column(c), fixed.HTML_TAG, " ")


def strip_urls(c: Column | str) -> Column:
    return F.regexp_replace(_column(c), fixed.URL, "")


def collapse_whitespace(c: Column | str) -> Column:
    """Every run of whitespace as one space, none at the ends.

    Matches only what changes: longer runs, and single characters other than a space.
    """
    return F.trim(F.regexp_replace(_column(c), fixed.WHITESPACE_TO_COLLAPSE, " "))


def normalise(c: Column | str) -> Column:
    """Text without tags and web addresses, single-spaced."""
    return collapse_whitespace(strip_urls(strip_html(c)))


def tokens(c: Column | str) -> Column:
    """Lower-case runs of a to z; other letters separate, too."""
    return F.split(F.lower(_column(c)), fixed.NON_LETTERS)


def keep_token(word: Column | str) -> Column:
    """Words long enough for the word frequency that are not stop words."""
    w = _column(word)
    stops = [s for s in fixed.STOP_WORDS if len(s) >= fixed.MIN_WORD_LENGTH]
    return (F.length(w) >= fixed.MIN_WORD_LENGTH) & ~w.isin(stops)


def lexicon_score(lowered: Column | str, words: tuple[str, ...]) -> Column:
    """How many of `words` occur anywhere in the lower-case text; each counts once.

    Pass a column that already holds the lower-case text, so it is lowered once per row.
    """
    return reduce(add, [F.contains(_column(lowered), F.lit(w)).cast("int") for w in words])


def sentiment_of(positive: Column | str, negative: Column | str) -> Column:
    """Label from two lexicon scores; a tie is neutral."""
    p, n = _column(positive), _column(negative)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def chunk_estimate(length: Column | str) -> Column:
    """Estimated number of chunks of a text of that length."""
    n = _column(length)
    step = float(fixed.CHUNK_SIZE - fixed.CHUNK_OVERLAP)
    return (
        F.when(n <= fixed.SHORT_TEXT, F.lit(1).cast("long"))
        .otherwise(F.ceil((n - fixed.CHUNK_OVERLAP) / F.lit(step)).cast("long"))
    )


def citation_snippet(c: Column | str, chars: int = fixed.CITATION_CHARS) -> Column:
    """Start of a text, with dots where something was cut off."""
    text = _column(c)
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(text)


def search_snippet(c: Column | str, chars: int = fixed.SEARCH_SNIPPET_CHARS) -> Column:
    return F.substring(_column(c), 1, chars)


def percent(share: Column | str) -> Column:
    """A share of one as a whole percentage, halves rounded up."""
    return F.floor(_column(share) * 100 + F.lit(0.5)).cast("long")


def day(c: Column | str) -> Column:
    return F.to_date(_column(c))


def keywords_json(c: Column | str) -> Column:
    """Keyword list as JSON text; no list becomes the empty list."""
    return F.to_json(F.coalesce(_column(c), F.array().cast("array<string>")))


def keywords_list(c: Column | str) -> Column:
    """Keyword list from its JSON text."""
    return F.coalesce(
        F.from_json(_column(c), "array<string>"), F.array().cast("array<string>")
    )
