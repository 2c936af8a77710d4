"""Records out of pages and forms."""

from pyspark.sql import functions as F

from . import query, table
from ..functions.forms import parse_forms
from ..functions.fixed_values import STAR_CAPTIONS, STAR_CLASSES
from ..sources.pages import NON_CONTENT, extract_records, page_coverage as coverage, review_records as records_of

_TEXT = r"""trim(replace(replace(replace(replace(replace(replace(regexp_replace({c}, '(?s)<[^>]*>', '', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'))"""


def _first(c, p):
    value = _TEXT.format(c=f"regexp_extract({c}, '{p}', 1)")
    return f"CASE WHEN regexp_matches({c}, '{p}') THEN {value} END"


BLOCK = r"(?s)<p>(.*?)</p>"
TITLE = [r"(?s)<h1>(.*?)</h1>", r"(?s)<title>(.*?)</title>"]
LEAD = [r"(?s)<b>(.*?)</b>", r"(?s)<b>(.*?)<br>"]


@query(f"""WITH c AS (SELECT page_id, regexp_replace(html, '{NON_CONTENT}', '', 'g') AS h FROM pages),
b AS (SELECT page_id, coalesce({_first('h', TITLE[0])}, {_first('h', TITLE[1])}, '-') AS title,
             unnest(regexp_extract_all(h, '{BLOCK}', 1)) AS blk, generate_subscripts(regexp_extract_all(h, '{BLOCK}', 1), 1)::INTEGER - 1 AS position FROM c)
SELECT page_id, position, title, coalesce({_first('blk', LEAD[0])}, {_first('blk', LEAD[1])}, '-') AS lead,
       md5({_TEXT.format(c='blk')}) AS body FROM b""")
def page_records(spark, sf):
    records = extract_records(
        table(spark, sf, "pages"), "page_id", "html", BLOCK,
        {"lead": LEAD, "body": [r"(?s)^(.*)$"]}, page_fields={"title": TITLE},
    )
    return records.select("page_id", "position", "title", "lead", F.md5("body").alias("body"))


@query(r"""WITH u AS (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS host, CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS page FROM pages)
SELECT host, count(DISTINCT page) AS n_pages, max(page) AS last_page FROM u GROUP BY host""")
def page_coverage(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"),
        F.regexp_extract("url", r"/(\d+)", 1).cast("bigint").alias("page"),
    )
    return coverage(pages, "host", "page")


def form_payload(e):
    """Nested form JSON built from an event row: text, dropdown and matrix fields."""
    item = lambda i, t: F.struct(F.lit(i).alias("id"), F.lit(t).alias("text"))
    none = F.lit(None).cast("array<struct<id:string,text:string>>")

    def field(label, kind, value, options=none, rows=none, columns=none):
        return (f'{{"label":"{label}","type":"{kind}","value":', value, options, rows, columns)

    column_items = F.array(*[item(f"c{i}", str(i)) for i in range(1, 6)], item("cx", "n/a"))
    rows = F.array(item("r1", "Work-life balance"), item("r2", "Senior management"))
    department = F.array(item("d0", "Sales"), item("d1", "Finance"))
    parts = [
        field("How would you summarize it?", "INPUT_TEXT", F.to_json(F.struct(F.col("event_type").alias("v")))),
        field("What do you LIKE MOST?", "TEXTAREA", F.to_json(F.struct(F.col("props").alias("v")))),
        field("Department", "DROPDOWN", F.concat(F.lit('{"v":["d'), (F.col("user_id") % 3).cast("string"), F.lit('"]}')), department),
        field("Rate", "MATRIX", F.concat(
            F.lit('{"v":{"r1":["c'), (F.col("user_id") % 8).cast("string"), F.lit('"],"r2":["cx"]}}')), none, rows, column_items),
    ]
    blocks = []
    for head, value, options, row_items, columns in parts:
        raw = F.regexp_extract(value, r'(?s)^\{"v":(.*)\}$', 1)
        rest = [F.concat(F.lit(f',"{n}":'), F.to_json(c)) for n, c in (("options", options), ("rows", row_items), ("columns", columns))]
        blocks.append(F.concat(F.lit(head), raw, *[F.coalesce(r, F.lit("")) for r in rest], F.lit("}")))
    return F.concat(
        F.lit('{"body":{"data":{"createdAt":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","fields":['),
        F.concat_ws(",", *blocks), F.lit("]}}}"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '' ELSE event_type END AS summary,
  CASE WHEN event_id % 97 = 0 THEN '' ELSE props END AS pros, '' AS cons,
  CASE WHEN event_id % 97 = 0 OR user_id % 3 = 2 THEN 'Engineering & Tech' WHEN user_id % 3 = 0 THEN 'Sales' ELSE 'Finance' END AS department,
  'Senior' AS seniority, 'Prefer not to say' AS gender,
  CASE WHEN event_id % 97 <> 0 AND user_id % 8 BETWEEN 1 AND 5 THEN (user_id % 8)::DOUBLE ELSE 3.0 END AS wl_balance,
  3.0::DOUBLE AS culture_values, 3.0::DOUBLE AS diversity_inclusion, 3.0::DOUBLE AS career_opportunities, 3.0::DOUBLE AS compensation_benefits,
  3.0::DOUBLE AS senior_management, CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN '2024-01-01' ELSE strftime(ts, '%Y-%m-%d') END AS submission_date
FROM events""")
def form_fields(spark, sf):
    """Payloads are built from the events; every 97th is cut short and must fall back to the defaults, every 89th has a
    creation time that is no date."""
    e = table(spark, sf, "events")
    payload = form_payload(e)
    payload = F.when(F.col("event_id") % 89 == 0, F.regexp_replace(payload, '"createdAt":"[^"]*"', '"createdAt":"soon"')).otherwise(payload)
    broken = F.when(F.col("event_id") % 97 == 0, F.substring(payload, 1, 9)).otherwise(payload)
    forms = parse_forms(e.select("event_id", broken.alias("payload")), "payload", ("event_id",), F.lit("2024-01-01T00:00:00Z"))
    return forms.drop("submitted_at")


_STARS = list(STAR_CLASSES)
_SUB = {name: f"(doc_id + {i}) % 7" for i, name in enumerate(STAR_CAPTIONS)}


def _review_pages(docs):
    """A page per document with a review in each layout; texts are escaped, class 0 and 6 are no star class."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n = F.col("doc_id").cast("string")
    tip = '<aside class="gd-ui-tooltip-info toolTip tooltip css-15sm7sw e1mbtzkk0"></aside>'
    stars = F.array(F.lit("css-none"), *[F.lit(c) for c in _STARS], F.lit("css-other"))
    ratings = [F.concat(F.lit(f"<div>{caption.replace('&', '&amp;')}</div><div class=\""), F.get(stars, F.expr(f"CAST({_SUB[name]} AS INT)")), F.lit(' e1"></div>'))
               for name, caption in STAR_CAPTIONS.items()]
    old = F.concat(
        F.lit('<li class="noBorder empReview cf pb-0 mb-0" id="old'), n, F.lit('"><a class="reviewLink" href="#">"No&nbsp;'), n, F.lit('"</a><span class="ratingNumber mr-xsm">'),
        (F.col("doc_id") % 5 + 1).cast("string"), F.lit(f".0</span>{tip}<div>"), *ratings, F.lit('</div><span class="authorInfo"><span>May '), (F.col("doc_id") % 28 + 1).cast("string"),
        F.lit(", 2021 - Job &amp; "), "lang", F.lit('</span></span><span class="authorLocation">Austin, TX</span><span data-test="pros">'), escaped,
        F.lit('</span><span data-test="cons">Long <b>hours</b></span></li>'))
    new = F.concat(
        F.lit('<li id="new'), n, F.lit('" class="noBorder empReview cf pb-0 mb-0"><span class="common__EiReviewDetailsStyle__newUiJobLine"><span>Jun 2, 2022 - Analyst&nbsp;in Town '),
        n, F.lit('</span></span><span data-test="pros">ok</span></li>'))
    decoy = F.lit("""<html><script>var x='<li class="noBorder empReview cf pb-0 mb-0" id="fake">';</script><ol>""")
    return docs.select("doc_id", F.concat(decoy, old, new, F.lit("</ol></html>")).alias("html"))


@query(f"""SELECT doc_id, 'old' || doc_id AS review_id, '"No' || chr(160) || doc_id || '"' AS summary, (doc_id % 5 + 1) || '.0' AS overall_rating, md5(trim(coalesce(text, ''))) AS pros,
'Long hours' AS cons, 'May ' || (doc_id % 28 + 1) || ', 2021' AS date, 'Job & ' || lang AS job_title, 'Austin, TX' AS author_location,
{', '.join(f"CASE WHEN {e} BETWEEN 1 AND 5 THEN CAST({e} AS VARCHAR) ELSE '-' END AS {name}" for name, e in _SUB.items())} FROM documents
UNION ALL SELECT doc_id, 'new' || doc_id, '-', '-', md5('ok'), '-', 'Jun 2, 2022', 'Analyst', 'Town ' || doc_id, {', '.join("'-'" for _ in _SUB)} FROM documents""")
def review_records(spark, sf):
    """All fourteen fields of reviews in both page layouts; the texts are those of the documents."""
    out = records_of(_review_pages(table(spark, sf, "documents")), "doc_id", "html")
    return out.withColumn("pros", F.md5("pros"))
