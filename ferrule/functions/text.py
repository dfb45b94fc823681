"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that feedback models leave out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def tokens(text: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits; a null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def content_tokens(text: str | Column) -> Column:
    """Tokens that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(text), lambda t: ~F.array_contains(stop, t))


def title_of(slug: str | Column) -> Column:
    """'some-slug' as 'Some Slug'."""
    c = F.col(slug) if isinstance(slug, str) else slug
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def overlap(a: str | Column, b: str | Column, sep: str = "-") -> Column:
    """How many distinct parts two slugs share."""
    x = F.col(a) if isinstance(a, str) else a
    y = F.col(b) if isinstance(b, str) else b
    return F.size(F.array_intersect(F.split(x, sep), F.split(y, sep)))


#: What of a page is no text: scripts, styles, comments, then tags.
PAGE_NOISE = ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "<[^>]*>")


def page_text(html: str | Column) -> Column:
    """Text of a raw page: scripts, styles, comments and tags give way to a space; a null page has none."""
    c = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    for pattern in PAGE_NOISE:
        c = F.regexp_replace(c, pattern, " ")
    return c
