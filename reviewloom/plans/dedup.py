"""Two sources of documents merged into one, without repeats."""

from pyspark.sql import functions as F

from . import query, sql_norm, table
from ..operators.dedup import add_keys, keep_first, key_overlap, merge_sources, new_keys_only, shared_keys, stage_counts
from ..session import written

_KEYED = f"""
d AS (SELECT doc_id, source, lang, n_chars, {sql_norm('text')} AS t FROM documents),
k AS (SELECT doc_id, source, lang, n_chars,
             substr(sha1(t || '||' || lower(source) || '|'), 1, 12) AS review_id,
             CASE WHEN length(t) < 20 THEN '' ELSE sha1(t || '|') END AS content_key,
             CASE WHEN CAST(substr(source, 4) AS INTEGER) < 10 THEN 0 ELSE 1 END AS is_b
      FROM d)"""
_MERGED = _KEYED + """,
b AS (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY doc_id) AS rn FROM k WHERE is_b = 1),
m AS (SELECT doc_id, source, n_chars, review_id, is_b FROM k WHERE is_b = 0
      UNION ALL
      SELECT doc_id, source, n_chars, review_id, is_b FROM b
      WHERE content_key = '' OR (rn = 1 AND content_key NOT IN (
            SELECT content_key FROM k WHERE is_b = 0 AND content_key <> ''))),
f AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY is_b, doc_id) AS rr FROM m)"""


def _keyed(spark, sf):
    """Keys are computed at the scan, so no text takes part in any shuffle."""
    docs = table(spark, sf, "documents")
    keyed = add_keys(docs, F.col("text"), F.lit(""), F.col("source"), F.lit(""))
    return keyed.select(
        "doc_id", "source", "lang", "n_chars", "review_id", "content_key",
        F.when(F.substring("source", 4, 10).cast("int") < 10, 0).otherwise(1).alias("is_b"),
    )


def _keyed_once(spark, sf):
    """The key table without texts, written once because several branches read it."""
    return written(_keyed(spark, sf), "keyed")


def _sides(keyed):
    return keyed.where("is_b = 0"), keyed.where("is_b = 1")


@query(f"""WITH {_MERGED}
SELECT source, count(*) AS n_reviews, round(avg(n_chars), 2) AS mean_chars
FROM f WHERE rr = 1 GROUP BY source""")
def review_merge_dedup(spark, sf):
    a, b = _sides(_keyed_once(spark, sf))
    merged = merge_sources(a, b, "content_key", ["doc_id"])
    final = keep_first(merged, "review_id", ["is_b", "doc_id"])
    return (
        final.groupBy("source")
        .agg(F.count("*").alias("n_reviews"), F.round(F.avg("n_chars"), 2).alias("mean_chars"))
        .orderBy(F.desc("n_reviews"), "source")
    )


@query(f"WITH {_KEYED} SELECT doc_id, review_id, content_key FROM k")
def content_keys(spark, sf):
    return _keyed(spark, sf).select("doc_id", "review_id", "content_key")


@query(f"""WITH {_KEYED},
p AS (SELECT content_key, max(1 - is_b) AS in_a, max(is_b) AS in_b FROM k WHERE content_key <> '' GROUP BY 1)
SELECT CAST(sum(in_a) AS BIGINT) AS keys_a, CAST(sum(in_b) AS BIGINT) AS keys_b,
       count(*) FILTER (in_a = 1 AND in_b = 1) AS keys_shared,
       round(count(*) FILTER (in_a = 1 AND in_b = 1) * 100.0 / greatest(sum(in_a), 1), 4)::DOUBLE AS duplicate_percent
FROM p""")
def source_overlap(spark, sf):
    keyed = _keyed(spark, sf).where("content_key <> ''")
    return key_overlap(keyed, "content_key", F.col("is_b") == 1).withColumn("duplicate_percent", F.round("duplicate_percent", 4))


@query(f"""WITH {_KEYED}
SELECT content_key FROM k WHERE is_b = 0 AND content_key <> ''
INTERSECT SELECT content_key FROM k WHERE is_b = 1""")
def shared_content_keys(spark, sf):
    a, b = _sides(_keyed_once(spark, sf).where("content_key <> ''"))
    return shared_keys(a, b, "content_key")


@query(f"""WITH {_KEYED}
SELECT doc_id, source FROM k WHERE is_b = 1 AND (content_key = '' OR content_key NOT IN (
    SELECT content_key FROM k WHERE is_b = 0 AND content_key <> ''))""")
def new_in_second_source(spark, sf):
    a, b = _sides(_keyed_once(spark, sf))
    return new_keys_only(b, a, "content_key").select("doc_id", "source")


@query(f"""WITH {_MERGED}
SELECT 0 AS stage, 'read' AS name, count(*) AS n_rows FROM k
UNION ALL SELECT 1, 'after_content', count(*) FROM m
UNION ALL SELECT 2, 'after_id', count(*) FROM f WHERE rr = 1""")
def removal_accounting(spark, sf):
    keyed = _keyed_once(spark, sf)
    merged = written(merge_sources(*_sides(keyed), "content_key", ["doc_id"]), "merged")
    final = keep_first(merged.select("doc_id", "is_b", "review_id"), "review_id", ["is_b", "doc_id"])
    return stage_counts({"read": keyed, "after_content": merged, "after_id": final})


@query("""SELECT lang, source FROM documents WHERE lang <> 'en'
UNION SELECT lang, source FROM documents WHERE n_chars > 1000""")
def union_distinct(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", "n_chars")
    by_lang, by_size = d.where("lang <> 'en'"), d.where("n_chars > 1000")
    return by_lang.unionByName(by_size).select("lang", "source").distinct()
