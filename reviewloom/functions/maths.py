"""Numeric, vector and decision expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed_values import (
    DEFAULT_RATING, LABEL_HIGH, LABEL_LOW, RATING_MAX, RATING_MIN, SATISFACTION_THRESHOLD,
)


def lenient_double(c: Column) -> Column:
    return c.try_cast("double")


def relative_spread(high: Column, low: Column) -> Column:
    """|(max - min) / max|, null when max is 0."""
    return F.abs((high - low) / F.nullif(high, F.lit(0.0)))


def percent_change(first: Column, last: Column, points: Column) -> Column:
    """(last - first) / first; 0 with fewer than two points or a zero base."""
    return F.when((points < 2) | (first == 0), F.lit(0.0)).otherwise(
        (last - first) / F.nullif(first, F.lit(0.0))
    )


def clip(c: Column, low: float, high: float) -> Column:
    """Clip that keeps null (greatest/least alone would replace it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def blend(model: Column, ratings: list[Column]) -> Column:
    """Half model, half mean rating, unless every rating is the untouched default."""
    untouched = F.lit(True)
    total = F.lit(0.0)
    for r in ratings:
        untouched = untouched & (r == F.lit(DEFAULT_RATING))
        total = total + r
    return F.when(untouched, model).otherwise(0.5 * model + 0.5 * (total / len(ratings)))


def satisfaction_label(rating: Column) -> Column:
    return F.when(rating >= SATISFACTION_THRESHOLD, F.lit(LABEL_HIGH)).otherwise(F.lit(LABEL_LOW))


def confidence(rating: Column) -> Column:
    return F.round(clip(F.abs(rating - SATISFACTION_THRESHOLD) / 2.0, 0.0, 1.0), 3)


def clip_rating(c: Column) -> Column:
    return clip(c, RATING_MIN, RATING_MAX)
