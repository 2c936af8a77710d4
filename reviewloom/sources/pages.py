"""Records out of stored HTML pages, as regex expressions over a page table.

A block pattern cuts a page into records; each field has patterns for the known
layouts, tried in order, and '-' when none matches.  Pages are exploded into
blocks before any field is read, so a page with many records is spread only as
far as its own row and no page is ever cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import MISSING_FIELD, STAR_CAPTIONS, STAR_CLASSES

NON_CONTENT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def clean_html(html: Column) -> Column:
    """Without scripts, styles and comments, whose text may look like markup."""
    return F.regexp_replace(html, NON_CONTENT, "")


def text_of(html: Column) -> Column:
    """Tags removed, the five named entities and nbsp decoded, trimmed."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.regexp_replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def first_layout(block: Column, patterns: list[str]) -> Column:
    """First pattern that matches, else the missing marker."""
    found = [F.when(F.regexp_count(block, F.lit(p)) > 0, text_of(F.regexp_extract(block, p, 1))) for p in patterns]
    return F.coalesce(*found, F.lit(MISSING_FIELD))


def extract_records(
    pages: DataFrame, key: str, html: str, block: str, fields: dict[str, list[str]], page_fields: dict[str, list[str]] = {},
) -> DataFrame:
    """``key``, ``position`` (from 0) and the fields, one row per block."""
    cleaned = pages.select(key, clean_html(F.col(html)).alias("_html"))
    blocks = cleaned.select(
        key, *[first_layout(F.col("_html"), p).alias(n) for n, p in page_fields.items()],
        F.posexplode(F.regexp_extract_all("_html", F.lit(block), F.lit(1))).alias("position", "_block"),
    )
    return blocks.select(
        key, "position", *page_fields, *[first_layout(F.col("_block"), p).alias(n) for n, p in fields.items()]
    )


# ---- review pages -------------------------------------------------------------

# Markup of a review record in its two layouts.
REVIEW_BLOCK = r'(?s)(<li\b[^>]*class="noBorder empReview cf pb-0 mb-0"[^>]*>.*?)(?=<li\b[^>]*class="noBorder empReview|\z)'
_HEADLINE = [
    r'(?s)<span\b[^>]*class="authorInfo"[^>]*>(.*?)</span>',
    r'(?s)<span\b[^>]*class="common__EiReviewDetailsStyle__newUiJobLine"[^>]*>(.*?)</span>\s*(?:<|$)',
]
REVIEW_FIELDS = {
    "review_id": [r'^<li\b[^>]*\bid="([^"]*)"'],
    "summary": [r'(?s)<a\b[^>]*class="reviewLink"[^>]*>(.*?)</a>'],
    "overall_rating": [r'(?s)<span\b[^>]*class="ratingNumber mr-xsm"[^>]*>(.*?)</span>'],
    "pros": [r'(?s)<span\b[^>]*data-test="pros"[^>]*>(.*?)</span>'],
    "cons": [r'(?s)<span\b[^>]*data-test="cons"[^>]*>(.*?)</span>'],
}
_TOOLTIP = "gd-ui-tooltip-info toolTip tooltip css-15sm7sw e1mbtzkk0"


def stars(css_class: Column) -> Column:
    """CSS class to a star count, '-' for an unknown class."""
    out = F.lit(MISSING_FIELD)
    for name, value in STAR_CLASSES.items():
        out = F.when(css_class == name, F.lit(value)).otherwise(out)
    return out


def sub_rating(block: Column, caption: str) -> Column:
    """Stars of the ``div`` after the caption's ``div``, if the block has exactly one tooltip."""
    escaped = "".join("\\" + ch if ch in "/&()." else ch for ch in caption.replace("&", "&amp;"))
    pattern = rf'(?s)<div[^>]*>\s*(?:{escaped}|{escaped.replace("amp;", "")})\s*</div>\s*<div\b[^>]*class="([^"\s]*)'
    one_tooltip = F.regexp_count(block, F.lit(rf'<aside\b[^>]*class="{_TOOLTIP}"')) == 1
    found = one_tooltip & (F.regexp_count(block, F.lit(pattern)) > 0)
    return F.when(found, stars(F.regexp_extract(block, pattern, 1))).otherwise(F.lit(MISSING_FIELD))


def review_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The fourteen review fields, one row per review block."""
    blocks = pages.select(key, F.explode(F.regexp_extract_all(
        clean_html(F.col(html)), F.lit(REVIEW_BLOCK), F.lit(1))).alias("_b"))
    b = F.col("_b")
    old, new = [
        F.when(F.regexp_count(b, F.lit(p)) > 0, text_of(F.regexp_extract(b, p, 1))) for p in _HEADLINE
    ]
    old_parts, new_parts = F.split(old, " - "), F.split(new, " - ")
    place = F.split(F.get(new_parts, F.lit(1)), " in ")
    located = r'(?s)<span\b[^>]*class="authorLocation"[^>]*>(.*?)</span>'
    missing = F.lit(MISSING_FIELD)
    return blocks.select(
        key,
        *[first_layout(b, p).alias(n) for n, p in REVIEW_FIELDS.items()],
        F.coalesce(F.get(old_parts, F.lit(0)), F.get(new_parts, F.lit(0)), missing).alias("date"),
        F.coalesce(F.get(old_parts, F.lit(1)), F.get(place, F.lit(0)), missing).alias("job_title"),
        F.coalesce(
            F.when(F.regexp_count(b, F.lit(located)) > 0, text_of(F.regexp_extract(b, located, 1))),
            F.get(place, F.lit(1)), missing,
        ).alias("author_location"),
        *[sub_rating(b, caption).alias(n) for n, caption in STAR_CAPTIONS.items()],
    )


def page_coverage(pages: DataFrame, company: str, page: str) -> DataFrame:
    """Pages present and last page per company: a failed range simply has no rows."""
    return pages.groupBy(company).agg(
        F.countDistinct(page).alias("n_pages"), F.max(page).alias("last_page")
    )
