"""The review flow and the preparation on invented rows."""

import datetime

from reviewloom.functions.fixed_values import CANONICAL_COLUMNS
from reviewloom.operators import prepare, reviews
from reviewloom.sources.tables import SOURCE_A_SCHEMA, SOURCE_B_SCHEMA
from tests.conftest import rows

LONG = "a long enough text about the place"


def _a(firm, pros, rating="4", date="2020-01-01"):
    return (firm, date, "dev", "yes", "London", rating, "x", "3.0", None, "1", "2", "5", "v", "o", "r", "head", pros, "")


def _b(slug, pros, rating="2.5", date="2021-05-05"):
    return (f"Reviews/{slug}-Reviews-E7.htm", date, "dev", "", rating, "1", "2", "3", "4", "5", "bad", "", "", "", "t", pros, "", "adv")


def test_merge_and_name(spark):
    a = spark.createDataFrame([
        _a("SSE ", LONG), _a("sse", LONG, date="2020-02-02"), _a("credit-suisse", LONG + "!"), _a("sse-energy", "short"), _a(None, LONG),
    ], SOURCE_A_SCHEMA)
    b = spark.createDataFrame([
        _b("SSE", LONG), _b("Sse", LONG + " new", "4"), _b("sse", LONG + " new", date="2022-01-01"), _b("sse", "tiny", "n/a"),
        _b("sse", "tiny", "n/a"), _b("other", LONG + " other"), ("no link",) + _b("x", LONG)[1:],
    ], SOURCE_B_SCHEMA)
    slugs = spark.createDataFrame([("sse",)], "slug string")
    merged = reviews.merge_reviews(a, b, slugs, "slug")
    assert merged.columns == CANONICAL_COLUMNS
    got = rows(merged.select("source", "company", "date", "overall_rating", "wl_balance", "advice"))
    assert sorted(map(str, got)) == sorted(map(str, [
        ("source_a", "sse", "2020-01-01", 4.0, None, None), ("source_a", "sse", "2020-02-02", 4.0, None, None),
        ("source_a", "sse-energy", "2020-01-01", 4.0, None, None),
        ("source_b", "sse", "2021-05-05", 4.0, 1.0, "adv"), ("source_b", "sse", "2021-05-05", None, 1.0, "adv"),
    ]))
    whitelist = spark.createDataFrame([("sse", "SSE.L", "SSE plc")], "slug string, ticker string, name string")
    known, unknown, summary = reviews.name_companies(merged, whitelist)
    assert known.columns[:5] == ["review_id", "source", "ticker", "company_canonical", "company"]
    assert rows(unknown) == [("sse-energy", 1)]
    assert rows(summary) == [("SSE.L", "SSE plc", 4, 4.0)]


def test_preparation_serves_unseen_rows(spark):
    day = datetime.date
    schema = "review_id string, overall_rating double, date date, Founded int, Sector string, `pros_ld_.` double, n int"
    train = spark.createDataFrame([
        ("a", 1.0, day(2020, 1, 1), 2000, "Finance", None, 1), ("b", 3.0, day(2021, 1, 1), 2000, "Finance", 0.5, 3),
        ("c", 5.0, day(2022, 1, 1), 2025, "Energy", 0.1, 5),
    ], schema)
    p = prepare.fit_preparation(train, "overall_rating", "date", "Founded", ["Sector"], ["Sector"])
    out = p.transform(train)
    assert {"Sector_targenc_mean", "Sector_targenc_median", "Sector_Finance_ohe", "days from review to t0"} <= set(out.columns)
    means = [abs(out.agg({f"`{c}`": "avg"}).first()[0]) for c in ("n", "pros_ld_.", "month", "Sector_targenc_mean")]
    assert max(means) < 1e-9
    assert [r[0] for r in rows(out.select("overall_rating"), "overall_rating")] == [1.0, 3.0, 5.0]
    served = p.transform(spark.createDataFrame([("z", None, day(2023, 1, 1), 1990, "New", None, 3)], schema)).first()
    assert abs(served["n"]) < 1e-9 and served["Sector_Finance_ohe"] < 0
