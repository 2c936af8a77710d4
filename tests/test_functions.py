"""Row-level traps: white space, nulls, ties, thresholds, odd JSON."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import dates, fixed_values, forms, maths, strings
from tests.conftest import rows

TEXTS = [None, "", "  a ", "\t a\nb \r\n", "a b", " Été  ", "\U0001f600 ok", "\x1c x \x1f", "ONE two"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def test_strip_words_and_lengths_follow_python(texts):
    got = rows(texts.select(
        "i", strings.norm_text(F.col("t")), strings.words(F.col("t")), strings.word_count(F.col("t")),
        F.length(F.coalesce("t", F.lit(""))),
    ), "i")
    for (i, norm, words, n, length), t in zip(got, TEXTS):
        t = t or ""
        assert norm == t.lower().strip(), i
        assert words == t.split(), i
        assert n == len(t.split()), i
        assert length == len(t), i


def test_content_key_floor(spark):
    df = spark.createDataFrame([("a" * 19, ""), ("a" * 20, ""), ("a" * 10, "b" * 11), (None, "c" * 25)], "p string, c string")
    keys = [r[0] for r in df.select(strings.content_key(strings.norm_text(F.col("p")), strings.norm_text(F.col("c")))).collect()]
    assert [k == "" for k in keys] == [True, False, False, False]
    import hashlib
    assert keys[1] == hashlib.sha1(("a" * 20 + "|").encode()).hexdigest()


def test_slug_from_url(spark):
    urls = ["Reviews/A-B-Reviews-E12.htm", "REVIEWS/x-reviews-e3.HTM", "http://h/Reviews/a/b-Reviews-E1.htm", "other", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = rows(df.select("i", strings.slug_from_url(F.col("u")), strings.slug_from_url(F.col("u"), strings.REVIEW_URL_STRICT)), "i")
    assert [g[1] for g in got] == ["a-b", "x", "a/b", None, None]
    assert [g[2] for g in got] == ["a-b", None, None, None, None]


def test_location_fields(spark):
    values = ["Austin, TX", "Austin, tx, USA", "Texas", "Missing value", None, "a,"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    filled = strings.replace_sentinel(F.col("v"), fixed_values.MISSING_LOCATION, F.lit("HQ, ny"))
    got = rows(df.select("i", strings.second_field(filled), strings.last_field(F.col("v"))), "i")
    assert [g[1] for g in got] == ["TX", "TX", "Texas", "NY", None, ""]
    assert [g[2] for g in got] == ["TX", "USA", None, None, None, None]


def test_keywords(spark):
    df = spark.createDataFrame([("The Coffee-machine is GREAT, coffée 123 work",)], "t string")
    words = df.select(F.explode(strings.raw_keywords(F.col("t"))).alias("w"))
    kept = [r[0] for r in words.where(strings.is_keyword(F.col("w"), fixed_values.DOMAIN_STOPWORDS)).collect()]
    assert kept == ["coffee", "machine", "coff"]


def test_contains_any_treats_null_as_empty(spark):
    df = spark.createDataFrame([("In LONDON",), (None,), ("Ukraine",)], "t string")
    assert [r[0] for r in df.select(strings.contains_any(F.col("t"), fixed_values.UK_KEYWORDS)).collect()] == [True, False, False]


def test_dates(spark):
    df = spark.createDataFrame([("2024-03-01",), ("2024-01-01",), ("2024-02-29",), ("no date",), (None,)], "s string")
    d = dates.lenient_date(F.col("s"))
    got = [tuple(r) for r in df.select(d, dates.previous_month_start(d), dates.year_start(d), dates.iso_date_or(F.col("s"), F.lit(datetime.date(2020, 1, 1)))).collect()]
    day = datetime.date
    assert got[0] == (day(2024, 3, 1), day(2024, 2, 1), day(2024, 1, 1), day(2024, 3, 1))
    assert got[1][1] == day(2023, 12, 1) and got[2][0] == day(2024, 2, 29)
    assert got[3] == (None, None, None, day(2020, 1, 1)) and got[4][3] == day(2020, 1, 1)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        df.select(dates.strict_date(F.col("s"))).collect()


def test_date_features_never_negative(spark):
    df = spark.createDataFrame([(datetime.date(2000, 1, 1), 2005), (datetime.date(2023, 12, 31), 1993)], "d date, f int")
    got = df.select(*[c.alias(n) for n, c in dates.date_features(F.col("d"), F.col("f"), "2024-01-01").items()]).collect()
    assert got[0]["days from foundation to review"] == 0
    assert got[1]["days from review to t0"] == 1 and got[1]["days from foundation to t0"] == 11322


def test_decision_edges(spark):
    cases = [(4.0, [3.0] * 6), (3.9999, [3.0] * 6), (5.0, [3.0] * 5 + [4.0]), (0.5, [1.0] * 6), (9.0, [5.0] * 6)]
    df = spark.createDataFrame([(i, p, *r) for i, (p, r) in enumerate(cases)], "i int, p double, " + ", ".join(f"r{j} double" for j in range(6)))
    rated = df.withColumn("b", maths.blend(F.col("p"), [F.col(f"r{j}") for j in range(6)]))
    got = rows(rated.select("i", "b", maths.satisfaction_label(F.col("b")), maths.confidence(F.col("b")), maths.clip_rating(F.col("b"))), "i")
    assert got[0][1:] == (4.0, "Alto", 0.0, 4.0)
    assert got[1][2] == "Bajo"
    assert math.isclose(got[2][1], 2.5 + 0.5 * 19 / 6)
    assert got[3][4] == 1.0 and got[4][3] == 1.0 and got[4][4] == 5.0


def test_cosine_zero_and_same(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 2.0]), (2, [1.0, 2.0], [2.0, 4.0])], "i int, a array<float>, b array<float>")
    assert [round(r[1], 9) for r in rows(df.select("i", maths.cosine(F.col("a"), F.col("b"))), "i")] == [0.0, 1.0]


def form(fields, created="2026-06-14T10:00:00Z"):
    return json.dumps({"body": {"data": {"createdAt": created, "fields": fields}}})


def test_forms(spark):
    opts = [{"id": "x", "text": "Sales"}]
    matrix = {
        "label": "Rate", "type": "MATRIX", "value": {"r1": ["c4"], "r2": ["c0"], "r3": []},
        "rows": [{"id": "r1", "text": "Work-Life balance"}, {"id": "r2", "text": "Culture"}, {"id": "r3", "text": "Diversity"}],
        "columns": [{"id": "c4", "text": "4 stars"}, {"id": "c0", "text": "none"}],
    }
    payloads = [
        form([{"label": "What do you like most?", "type": "TEXTAREA", "value": "food"},
              {"label": "DEPARTMENT", "type": "DROPDOWN", "value": ["x"], "options": opts}, matrix]),
        form([{"label": "department", "type": "DROPDOWN", "value": ["gone"], "options": opts}]),
        "not json", None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    got = forms.parse_forms(df, "p", ("i",), F.lit("2020-01-01T00:00:00Z")).orderBy("i").collect()
    assert (got[0]["pros"], got[0]["cons"], got[0]["department"]) == ("food", "", "Sales")
    assert [got[0][c] for c in ("wl_balance", "culture_values", "diversity_inclusion", "senior_management")] == [4.0, 3.0, 3.0, 3.0]
    assert got[0]["submission_date"] == "2026-06-14"
    assert got[1]["department"] == "Engineering & Tech"
    for r in got[2:]:
        assert (r["summary"], r["seniority"], r["wl_balance"], r["submission_date"]) == ("", "Senior", 3.0, "2020-01-01")
