"""String expressions.  Plain column functions: no UDF, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed_values import MIN_KEY_LENGTH

# Every character Python's str.strip()/str.split() treats as white space.  The
# class is spelled out because ``\s`` is ASCII-only in both Java and RE2.
WS = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_ws(c: Column) -> Column:
    """Trim by character list: looks at the ends only, where a regex would scan the text."""
    return F.trim(c, F.lit(WS_CHARS))


def norm_text(c: Column) -> Column:
    """Null to empty, lower case, all surrounding white space removed."""
    return strip_ws(F.lower(F.coalesce(c, F.lit(""))))


def words(c: Column) -> Column:
    """White-space tokens; an empty or blank text has none."""
    stripped = strip_ws(F.coalesce(c, F.lit("")))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, f"{WS}+"))


def word_count(c: Column) -> Column:
    """Number of white-space tokens without building them: gaps plus one."""
    stripped = strip_ws(F.coalesce(c, F.lit("")))
    return F.when(stripped == "", F.lit(0)).otherwise(F.size(F.split(stripped, f"{WS}+")))


def letter_words(c: Column) -> Column:
    """Lower-cased runs of letters, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+"), lambda t: t != "")


def raw_keywords(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, before length and stop-word filters."""
    return F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+")


def is_keyword(word: Column, stopwords: list[str]) -> Column:
    """Four letters or more and no stop word."""
    keep = F.length(word) > 3
    return keep & ~word.isin(*stopwords) if stopwords else keep


def review_id(pros: Column, cons: Column, company: Column, date: Column) -> Column:
    """First 12 hex digits of SHA-1 over fields that :func:`norm_text` has normalised."""
    return F.substring(F.sha1(F.concat_ws("|", pros, cons, company, date)), 1, 12)


def content_key(pros: Column, cons: Column, min_length: int = MIN_KEY_LENGTH) -> Column:
    """SHA-1 of two normalised texts, or '' when together they are too short."""
    return F.when(F.length(pros) + F.length(cons) < min_length, F.lit("")).otherwise(
        F.sha1(F.concat_ws("|", pros, cons))
    )


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex capture with null for "no match" (Spark alone returns '')."""
    return F.when(F.regexp_count(c, F.lit(pattern)) > 0, F.regexp_extract(c, pattern, group))


REVIEW_URL_LOOSE = r"(?i)Reviews/(.+)-Reviews-E\d+\.htm"
REVIEW_URL_STRICT = r"Reviews/([^/]+)-Reviews-E\d+\.htm"


def slug_from_url(c: Column, pattern: str = REVIEW_URL_LOOSE) -> Column:
    return F.lower(capture(c, pattern))


def second_field(c: Column) -> Column:
    """Second comma-separated field, trimmed and upper-cased; the value itself without a comma."""
    parts = F.split(c, ",", -1)
    return F.when(F.size(parts) >= 2, F.upper(strip_ws(parts.getItem(1)))).otherwise(c)


def last_field(c: Column) -> Column:
    """Text after the last comma, null without one."""
    return strip_ws(capture(c, r",\s*([^,]+)$"))


def contains_any(c: Column, keywords: list[str]) -> Column:
    """True when any keyword occurs in the lower-cased text; null counts as empty."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k)
    return hit


def replace_sentinel(c: Column, sentinel: str, fallback: Column) -> Column:
    """Anything but the sentinel stays, nulls included."""
    return F.when(c.eqNullSafe(F.lit(sentinel)), fallback).otherwise(c)
