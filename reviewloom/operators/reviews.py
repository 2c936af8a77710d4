"""The review flow end to end: two dialects to one clean table, then to company names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import CANONICAL_COLUMNS, SUB_RATINGS
from ..functions.strings import norm_text, slug_from_url
from ..session import written
from ..sources.tables import SOURCE_A_MAP, SOURCE_B_MAP
from .align import align, keep_existing
from .bounds import settle
from .dedup import add_keys, keep_first, merge_sources
from .matching import keep_matching, map_whitelist, slug_matches
from .profile import count_and_mean

RATINGS = ("overall_rating", *SUB_RATINGS)


def canonical(df: DataFrame, mapping: dict, source: str, company: Column) -> DataFrame:
    """Canonical columns of one dialect, with its source name and lenient ratings."""
    return align(df, {**mapping, "source": F.lit(source), "company": company}, numeric=RATINGS)


def merge_reviews(
    first: DataFrame, second: DataFrame, slugs: DataFrame, slug: str, order: list[str] | None = None,
    names: tuple[str, str] = ("source_a", "source_b"),
) -> DataFrame:
    """Both sources, limited to listed companies, without repeated reviews.

    The first source wins; among equal rows the one that comes first by
    ``order`` (default: date and the generated id) stays.
    """
    a = canonical(first, SOURCE_A_MAP, names[0], norm_text(F.col("firm")))
    b = canonical(second, SOURCE_B_MAP, names[1], slug_from_url(F.col("firm_link")))
    order = order or ["date", "review_id", "company"]
    sides = []
    for df in (a, b):
        listed = settle(slug_matches(df, "company", slugs, slug), "listed-slugs")
        kept = keep_matching(df, "company", listed)
        keyed = add_keys(kept, F.col("pros"), F.col("cons"), F.col("company"), F.col("date"))
        sides.append(written(keyed.withColumn("_row", F.monotonically_increasing_id()), "reviews"))
    # Winners are chosen on keys alone; texts are only read again for the rows that stay.
    narrow = [s.select("_row", "source", "content_key", *dict.fromkeys(["review_id", *order])) for s in sides]
    winners = keep_first(merge_sources(*narrow, "content_key", [*order, "_row"]), "review_id", ["source", *order, "_row"])
    unique = sides[0].unionByName(sides[1]).join(winners.select("source", "_row"), ["source", "_row"], "left_semi")
    return keep_existing(unique, CANONICAL_COLUMNS)


def name_companies(reviews: DataFrame, whitelist: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews with ticker and company name, rejected slugs with counts, reviews and mean rating per company).

    ``whitelist`` has ``slug``, ``ticker`` and ``name``.
    """
    dictionary = whitelist.select("slug", "ticker", F.col("name").alias("company_canonical"))
    known, unknown = map_whitelist(reviews, "company", dictionary, "slug")
    ordered = ["review_id", "source", "ticker", "company_canonical", *CANONICAL_COLUMNS[2:]]
    known = keep_existing(known, ordered)
    return known, unknown, count_and_mean(known, ["ticker", "company_canonical"], "overall_rating")
