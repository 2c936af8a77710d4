"""The review flow on documents dressed as two dialects: merge, names, links."""

from pyspark.sql import functions as F

from . import query, sql_norm, table
from ..functions.fixed_values import CANONICAL_COLUMNS
from ..functions.strings import REVIEW_URL_STRICT, slug_from_url
from ..operators import reviews as R
from ..session import written

# Every value is a function of text, source and firm spelling, so that equal reviews are equal rows.
_NUMBER = "TRY_CAST(substr(source, 4) AS INTEGER)"
_SHARED = {
    "day": "concat('2020-01-', lpad(CAST(length(t) % 28 + 1 AS STRING), 2, '0'))",
    "rating": "CASE WHEN length(t) % 6 = 5 THEN 'n/a' ELSE CAST(length(t) % 5 + 1 AS STRING) END",
    "half": "concat(CAST(length(t) % 4 AS STRING), '.5')",
    "head": "substr(t, 1, 20)",
}
_FIRM = "CASE doc_id % 3 WHEN 0 THEN concat(source, '  ') WHEN 1 THEN upper(source) ELSE concat(source, '-group') END"
_LINK = ("CASE WHEN doc_id % 5 = 0 THEN 'no link' WHEN doc_id % 5 = 1 THEN concat('reviews/', source, '-reviews-e', CAST(doc_id AS STRING), '.HTM') "
         "ELSE concat('https://x/Reviews/', source, '-Reviews-E', CAST(doc_id AS STRING), '.htm') END")


def _duck(expression):
    return expression.replace("AS STRING", "AS VARCHAR")


def _documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    return d.selectExpr("*", f"{_NUMBER} AS number", *[f"{e} AS {n}" for n, e in _SHARED.items()])


def _dialects(spark, sf):
    d = _documents(spark, sf)
    a = d.where("number < 10").selectExpr(
        f"{_FIRM} AS firm", "day AS date_review", "'dev' AS job_title", "'yes' AS current", "concat('London, ', source) AS location",
        "rating AS overall_rating", "half AS work_life_balance", "CAST(NULL AS STRING) AS culture_values", "'x' AS diversity_inclusion",
        "'3' AS career_opp", "'2' AS comp_benefits", "'1' AS senior_mgmt", "'v' AS recommend", "'o' AS ceo_approv", "'r' AS outlook",
        "head AS headline", "t AS pros", "'' AS cons")
    b = d.where("number >= 10 OR number % 3 = 0").selectExpr(
        f"{_LINK} AS firm_link", "day AS date", "'ops' AS job", "'no' AS status", "rating", "half AS `Work/Life Balance`", "'1' AS `Culture & Values`",
        "'2' AS `Diversity & Inclusion`", "'3' AS `Career Opportunities`", "'4' AS `Compensation and Benefits`", "'bad' AS `Senior Management`",
        "'R' AS Recommend", "'C' AS `CEO Approval`", "'B' AS `Business Outlook`", "head AS title", "t AS pros", "'' AS cons", "'adv' AS advice")
    slugs = d.where("number % 4 <> 3").select(F.col("source").alias("slug")).distinct()
    return a, b, slugs


_MERGED = f"""
d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_NUMBER} AS number FROM documents),
s AS (SELECT *, {', '.join(f'{_duck(e)} AS {n}' for n, e in _SHARED.items())}, {_duck(_FIRM)} AS firm, {_duck(_LINK)} AS link FROM d),
x AS (SELECT 0 AS side, 'source_a' AS src, {sql_norm('firm')} AS company, 'dev' AS job_title, 'yes' AS current, concat('London, ', source) AS location,
             NULL::DOUBLE AS culture, NULL::DOUBLE AS diversity, 3.0::DOUBLE AS career, 2.0::DOUBLE AS compensation, 1.0::DOUBLE AS senior,
             'v' AS recommend, 'o' AS ceo_approv, 'r' AS outlook, NULL::VARCHAR AS advice, day, rating, half, head, t FROM s WHERE number < 10
      UNION ALL
      SELECT 1, 'source_b', lower(regexp_extract(link, 'Reviews/(.+)-Reviews-E\\d+\\.htm', 1, 'i')), 'ops', 'no', NULL, 1.0, 2.0, 3.0, 4.0, NULL,
             'R', 'C', 'B', 'adv', day, rating, half, head, t FROM s WHERE (number >= 10 OR number % 3 = 0) AND link <> 'no link'),
l AS (SELECT DISTINCT source AS slug FROM d WHERE number % 4 <> 3),
k AS (SELECT x.*, {sql_norm('t')} AS n FROM x WHERE EXISTS (
      SELECT 1 FROM l WHERE company = slug OR starts_with(company, slug || '-') OR ends_with(company, '-' || slug))),
i AS (SELECT *, substr(sha1(n || '||' || company || '|' || day), 1, 12) AS review_id, CASE WHEN length(n) < 20 THEN '' ELSE sha1(n || '|') END AS ck FROM k),
w AS (SELECT *, row_number() OVER (PARTITION BY side, ck ORDER BY day, review_id, company) AS rn FROM i),
m AS (SELECT * FROM w WHERE side = 0 OR ck = '' OR (rn = 1 AND ck NOT IN (SELECT ck FROM i WHERE side = 0 AND ck <> ''))),
f AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY src, day, company) AS rr FROM m),
r AS (SELECT review_id, src AS source, company, day AS date, job_title, current, location, TRY_CAST(rating AS DOUBLE) AS overall_rating,
        TRY_CAST(half AS DOUBLE) AS wl_balance, culture AS culture_values, diversity AS diversity_inclusion, career AS career_opportunities,
        compensation AS compensation_benefits, senior AS senior_management, recommend, ceo_approv, outlook, head AS summary, t AS pros, '' AS cons, advice
      FROM f WHERE rr = 1)"""


def _merged(spark, sf):
    a, b, slugs = _dialects(spark, sf)
    return R.merge_reviews(a, b, slugs, "slug")


@query(f"WITH {_MERGED} SELECT {', '.join(CANONICAL_COLUMNS)} FROM r")
def merge_reviews(spark, sf):
    """Both dialects as one canonical table of 21 columns, limited to listed companies, without repeats."""
    return _merged(spark, sf)


def _named(spark, sf):
    whitelist = table(spark, sf, "documents").select("source").distinct().where(f"{_NUMBER} % 2 = 0").selectExpr(
        "source AS slug", "concat('T', substr(source, 4)) AS ticker", "concat('Company ', substr(source, 4)) AS name")
    return R.name_companies(written(_merged(spark, sf), "merged-reviews"), whitelist)


@query(f"WITH {_MERGED} SELECT company, count(*) AS n_rows FROM r WHERE NOT (company IN (SELECT source FROM d WHERE number % 2 = 0)) GROUP BY 1")
def rejected_slugs(spark, sf):
    """Companies that the whitelist lacks, with their reviews."""
    return _named(spark, sf)[1]


@query(f"""WITH {_MERGED} SELECT concat('T', substr(company, 4)) AS ticker, concat('Company ', substr(company, 4)) AS company_canonical,
count(*) AS n_rows, round(avg(overall_rating), 2) AS mean_value FROM r WHERE company IN (SELECT source FROM d WHERE number % 2 = 0) GROUP BY 1, 2""")
def company_summary(spark, sf):
    """Reviews and mean rating of the companies that the whitelist names."""
    return _named(spark, sf)[2]


@query(f"""WITH s AS (SELECT doc_id, {_duck(_LINK)} AS link FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(link, 'Reviews/(.+)-Reviews-E\\d+\\.htm', 'i') THEN lower(regexp_extract(link, 'Reviews/(.+)-Reviews-E\\d+\\.htm', 1, 'i')) END AS loose,
CASE WHEN regexp_matches(link, 'Reviews/([^/]+)-Reviews-E\\d+\\.htm') THEN lower(regexp_extract(link, 'Reviews/([^/]+)-Reviews-E\\d+\\.htm', 1)) END AS strict FROM s""")
def review_url_slugs(spark, sf):
    """The company in a review link, by the loose and the strict pattern."""
    links = table(spark, sf, "documents").select("doc_id", F.expr(_LINK).alias("link"))
    return links.select("doc_id", slug_from_url(F.col("link")).alias("loose"), slug_from_url(F.col("link"), REVIEW_URL_STRICT).alias("strict"))
