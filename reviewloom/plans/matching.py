"""Slugs of part names against lists taken from the data."""

from pyspark.sql import functions as F

from . import query, table
from ..functions.fixed_values import UK_KEYWORDS
from ..functions.strings import capture, contains_any
from ..operators.align import company_rows
from ..operators.bounds import settle
from ..operators.encode import hash_split
from ..operators.matching import (
    entity_presence as presence, entries_in_use, map_whitelist, slug_matches, substring_matches,
)
from ..operators.profile import top_groups

KEYWORDS = ["licen", "copyright", "http", "@", "password"] + UK_KEYWORDS

_SLUGS = """
s AS (SELECT *, replace(lower(p_name), ' ', '-') AS slug FROM part),
w AS (SELECT unnest(string_split(slug, '-')) AS word FROM s),
top AS (SELECT word FROM w GROUP BY word ORDER BY count(*) DESC, word LIMIT 5)"""


def _parts(spark, sf):
    return table(spark, sf, "part").withColumn("slug", F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")))


def _top_words(parts, n=5):
    return settle(top_groups(parts.select(F.explode(F.split("slug", "-")).alias("word")), ["word"], n).select("word"), "words")


def _flag(df, pairs, name):
    hits = settle(pairs.select("slug").distinct().withColumn(name, F.lit(1)), "slug-hits")
    return df.join(hits, "slug", "left")


@query(f"""WITH {_SLUGS}
SELECT p_brand, count(*) AS n_parts,
  count(*) FILTER (EXISTS (SELECT 1 FROM top WHERE slug = word OR starts_with(slug, word || '-') OR ends_with(slug, '-' || word))) AS n_slug_match,
  count(*) FILTER (EXISTS (SELECT 1 FROM top WHERE contains(slug, word))) AS n_substring_match
FROM s GROUP BY p_brand""")
def slug_match(spark, sf):
    parts = _parts(spark, sf).select("p_brand", "slug")
    words = _top_words(parts)
    flagged = _flag(parts, slug_matches(parts, "slug", words, "word"), "strict")
    flagged = _flag(flagged, substring_matches(parts, "slug", words, "word"), "loose")
    return flagged.groupBy("p_brand").agg(
        F.count("*").alias("n_parts"), F.count("strict").alias("n_slug_match"),
        F.count("loose").alias("n_substring_match"),
    )


_HIT = " OR ".join(f"contains(t, '{k}')" for k in KEYWORDS)


@query(f"""WITH d AS (SELECT *, lower(coalesce(text, '')) AS t FROM documents)
SELECT source, count(*) AS n_docs, count(*) FILTER ({_HIT}) AS n_keyword,
       count(*) FILTER (({_HIT}) OR lang = 'fr') AS n_kept
FROM d GROUP BY source""")
def keyword_filter(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", contains_any(F.col("text"), KEYWORDS).alias("hit"))
    return d.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if("hit").alias("n_keyword"),
        F.count_if(F.col("hit") | (F.col("lang") == "fr")).alias("n_kept"),
    )


@query("""WITH s AS (SELECT *, replace(lower(p_name), ' ', '-') AS slug FROM part),
e AS (SELECT DISTINCT split_part(slug, '-', 1) AS entity FROM s),
es AS (SELECT entity, unnest([entity || '-ring', entity || '-rod']) AS entry FROM e),
h AS (SELECT DISTINCT entity, p_partkey, p_size FROM s, es WHERE contains(slug, entry))
SELECT entity, count(*) FILTER (p_size <= 25) AS rows_a, count(*) FILTER (p_size > 25) AS rows_b, count(*) AS total
FROM h GROUP BY entity""")
def entity_presence(spark, sf):
    parts = _parts(spark, sf).select("slug", "p_size")
    word = F.split("slug", "-").getItem(0)
    entities = parts.select(word.alias("entity")).distinct().select(
        "entity", F.explode(F.array(F.concat("entity", F.lit("-ring")), F.concat("entity", F.lit("-rod")))).alias("entry")
    )
    return presence(
        settle(entities, "entities"), "entity", "entry", parts.where("p_size <= 25"), parts.where("p_size > 25"), "slug"
    )


@query("""WITH s AS (SELECT *, replace(lower(p_name), ' ', '-') AS slug FROM part),
dict AS (SELECT slug, 'T' || substr(md5(slug), 1, 6) AS ticker, upper(slug) AS name
         FROM s GROUP BY slug ORDER BY count(*) DESC, slug LIMIT 20)
SELECT 'known' AS kind, ticker, name AS label, count(*) AS n_rows, round(avg(p_retailprice), 2) AS mean_value
FROM s JOIN dict USING (slug) GROUP BY ticker, name
UNION ALL
SELECT 'unknown', NULL, slug, count(*), NULL FROM s WHERE slug NOT IN (SELECT slug FROM dict) GROUP BY slug""")
def whitelist_map(spark, sf):
    parts = _parts(spark, sf).select("slug", "p_retailprice")
    top = top_groups(parts, ["slug"], 20)
    whitelist = settle(top.select(
        "slug", F.concat(F.lit("T"), F.substring(F.md5("slug"), 1, 6)).alias("ticker"), F.upper("slug").alias("name")
    ), "whitelist")
    known, unknown = map_whitelist(parts, "slug", whitelist, "slug")
    summary = known.groupBy("ticker", "name").agg(
        F.count("*").alias("n_rows"), F.round(F.avg("p_retailprice"), 2).alias("mean_value")
    )
    return summary.select(
        F.lit("known").alias("kind"), "ticker", F.col("name").alias("label"), "n_rows", "mean_value"
    ).unionByName(unknown.select(
        F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("ticker"), F.col("slug").alias("label"),
        "n_rows", F.lit(None).cast("double").alias("mean_value"),
    ))


@query("""WITH s AS (SELECT DISTINCT replace(lower(p_name), ' ', '-') AS slug FROM part),
e AS (SELECT DISTINCT lower(p_type) AS entry FROM part
      UNION SELECT DISTINCT substr(slug, 1, 5) FROM s)
SELECT entry, CASE WHEN EXISTS (SELECT 1 FROM s WHERE contains(slug, entry)) THEN 1 ELSE 0 END AS used FROM e""")
def entry_in_use(spark, sf):
    parts = _parts(spark, sf)
    entries = parts.select(F.lower("p_type").alias("entry")).union(parts.select(F.substring("slug", 1, 5))).distinct()
    return entries_in_use(parts, "slug", entries, "entry")


_URL = r"(?i)^https?://([^/]+)/([a-z]{2})/(\d+)"


@query(rf"""SELECT page_id, nullif(regexp_extract(url, '{_URL}', 1), '') AS host,
       lower(nullif(regexp_extract(url, '{_URL}', 2), '')) AS lang,
       TRY_CAST(nullif(regexp_extract(url, '{_URL}', 3), '') AS BIGINT) AS number
FROM pages""")
def slug_from_url(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", capture(url, _URL, 1).alias("host"), F.lower(capture(url, _URL, 2)).alias("lang"),
        capture(url, _URL, 3).try_cast("bigint").alias("number"),
    )


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def one_company(spark, sf):
    o = hash_split(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    train, test = o.where("split = 'train'"), o.where("split = 'test'")
    return company_rows(train, test, "o_orderpriority", "1-URGENT").drop("split")
