"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict_date(c: Column, fmt: str | None = None) -> Column:
    """Raises on a value that is no date (ANSI mode)."""
    return F.to_date(c, fmt) if fmt else F.to_date(c)


def lenient_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Null for a value that is no date."""
    return F.to_date(F.try_to_timestamp(c, F.lit(fmt)))


def iso_date_or(c: Column, fallback: Column) -> Column:
    """ISO date, else the fallback (``current_date()`` when serving)."""
    return F.coalesce(lenient_date(c), fallback)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def founding_day(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def previous_month_start(c: Column) -> Column:
    return F.to_date(F.add_months(F.trunc(c, "MM"), -1))


def year_start(c: Column) -> Column:
    return F.to_date(F.trunc(c, "YYYY"))


def month_index(c: Column) -> Column:
    """Months since year 0: consecutive integers for consecutive months."""
    return F.year(c) * 12 + F.month(c) - 1


def date_features(date: Column, founded: Column, t0: str) -> dict[str, Column]:
    """Month, year and the three day differences; the last one never below 0."""
    ref = F.to_date(F.lit(t0))
    return {
        "month": F.month(date),
        "year": F.year(date),
        "days from review to t0": days_between(ref, date),
        "days from foundation to t0": days_between(ref, founding_day(founded)),
        "days from foundation to review": F.greatest(
            F.lit(0), days_between(date, founding_day(founded))
        ),
    }
