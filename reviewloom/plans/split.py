"""Seeded split, folds and row numbers without a global sort."""

from pyspark.sql import functions as F

from . import query, sql_split, table
from ..operators.encode import hash_split as split
from ..operators.ranks import contiguous_folds, with_row_number
from ..sources.tables import first_rows

BUCKET_ROWS = 4000  # small enough that the bucketed path runs on this data


@query(f"SELECT o_orderkey, {sql_split('o_orderkey')} AS split FROM orders")
def hash_split(spark, sf):
    return split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def fold_assign(spark, sf):
    return contiguous_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", rows_per_bucket=BUCKET_ROWS)


@query("SELECT row_number() OVER (ORDER BY event_id) AS row_number, event_id FROM events")
def row_index(spark, sf):
    numbered = with_row_number(table(spark, sf, "events").select("event_id"), "event_id", rows_per_bucket=BUCKET_ROWS)
    return numbered.select("row_number", "event_id")


@query("SELECT md5(doc_id::VARCHAR) AS review_id, CAST(ntile(5) OVER (ORDER BY md5(doc_id::VARCHAR)) - 1 AS INTEGER) AS fold, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) AS row_number FROM documents")
def text_key_folds(spark, sf):
    """Folds and row numbers in the order of a text key."""
    ids = table(spark, sf, "documents").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("review_id"))
    return with_row_number(contiguous_folds(ids, "review_id", rows_per_bucket=BUCKET_ROWS), "review_id", rows_per_bucket=BUCKET_ROWS)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5000")
def prefix_sample(spark, sf):
    """Calibration reads the first rows of a table: the row limit is the operator."""
    return first_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5000)
