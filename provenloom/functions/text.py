"""Text as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import SENTENCE_END

# Typography that makes no difference between a quote and its page; U+00AD (soft hyphen) is dropped.
_FROM = "\u00ab\u00bb\u201c\u201d\u201e\u201f" + "\u2018\u2019\u201a" + "\u2013\u2014\u2010\u2011\u2212" + "\u00a0\u202f\u2009\u2007" + "\u0451\u0401" + "\u00ad"
_TO = '"' * 6 + "'" * 3 + "-" * 5 + " " * 4 + "\u0435\u0415"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() knows U+0020 only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_page(c: Column) -> Column:
    """Page text: line ends as LF, soft hyphens gone, words joined over hyphenated breaks, runs of spaces and blank lines cut."""
    c = F.translate(F.regexp_replace(c, "\r\n?", "\n"), "\u00ad", "")
    c = F.regexp_replace(c, r"(?U)(\w)[-\u2010\u2011]\s*\n\s*(\w)", "$1$2")
    c = F.regexp_replace(c, "[ \t\u00a0\u202f]{2,}", " ")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    return strip(c)


def normalize_quote(c: Column) -> Column:
    """The form in which quotes and pages are compared."""
    return collapse(F.lower(F.translate(c, _FROM, _TO)))


def digit_tokens(c: Column) -> Column:
    """Distinct numbers of three digits or more, digits only."""
    found = F.regexp_extract_all(c, F.lit(r"\d[\d .,]*\d|\d"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"\D", "")), lambda x: F.length(x) >= 3))


def sentences(c: Column, boundary: str = SENTENCE_END) -> Column:
    """Sentences of a text in order, white space collapsed, blanks dropped."""
    parts = F.transform(F.split(F.translate(c, "\n", " "), boundary), collapse)
    return F.filter(parts, lambda x: x != "")


def significant_words(c: Column) -> Column:
    """Words that must be found again: with a digit from three characters on, others from four."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"(?U)([\w./-]+)"), F.lit(1)), lambda w: F.when(w.rlike(r"\d"), F.length(w) >= 3).otherwise(F.length(w) >= 4))


def cut(c: Column, limit: int) -> Column:
    """At most so many characters, ended at a word where one ends past the half, and marked by an ellipsis."""
    c = strip(c)
    head = F.substring(c, 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    at = F.when((F.locate(" ", head) > 0) & (space > limit // 2), F.left(head, space)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(at, r"[ ,;:-]+$", ""), F.lit("…")))


def pages_label(pages: Column) -> Column:
    return F.when(F.size(pages) == 0, "—").when(F.size(pages) == 1, F.array_min(pages).cast("string")).otherwise(F.concat_ws("–", F.array_min(pages).cast("string"), F.array_max(pages).cast("string")))


def money_text(amount: Column) -> Column:
    """1234567.89 as '1 234 567,89 руб.'."""
    return F.concat(F.translate(F.format_number(amount, 2), ",.", " ,"), F.lit(" руб."))


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9._-]", "_"), 1, 64)


def result_key(version: str, provider: Column, model: Column, content_hash: Column) -> Column:
    return F.concat_ws("-", F.lit(version), safe_name(provider), safe_name(model), F.substring(content_hash, 1, 32))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out
