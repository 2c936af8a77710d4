"""Alignment, casts and reshaping."""

from pyspark.sql import functions as F

from . import query, table
from ..functions.maths import lenient_double
from ..operators.align import align, align_signature, keep_existing, melt, pivot_series, rename_prefixed, with_defaults
from ..operators.bounds import distinct_values
from ..sources.tables import union_all

ORDER = ["account_id", "source", "name", "nation_key", "balance", "segment", "not_there"]


@query("""SELECT 'C' || c_custkey AS account_id, 'customers' AS source, c_name AS name, c_nationkey AS nation_key,
       c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL
SELECT 'S' || s_suppkey, 'suppliers', s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def align_sources(spark, sf):
    customers = align(table(spark, sf, "customer"), {
        "source": F.lit("customers"), "account_id": F.concat(F.lit("C"), F.col("c_custkey").cast("string")),
        "name": "c_name", "nation_key": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment",
        "helper": "c_custkey",
    }, numeric=("balance",)).drop("helper")
    suppliers = align(table(spark, sf, "supplier"), {
        "source": F.lit("suppliers"), "account_id": F.concat(F.lit("S"), F.col("s_suppkey").cast("string")),
        "name": "s_name", "nation_key": "s_nationkey", "balance": "s_acctbal", "segment": None,
    }, numeric=("balance",))
    return keep_existing(union_all(customers, suppliers), ORDER)


@query("""WITH e AS (SELECT event_type, TRY_CAST(substr(props, 7, 2) AS DOUBLE) AS v, value FROM events)
SELECT event_type, count(*) AS n_rows, count(v) AS n_numeric, count(*) - count(v) AS n_coerced, sum(v) AS total
FROM e GROUP BY event_type""")
def lenient_cast(spark, sf):
    e = table(spark, sf, "events").select("event_type", lenient_double(F.substring("props", 7, 2)).alias("v"))
    return e.groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.count("v").alias("n_numeric"),
        F.count_if(F.col("v").isNull()).alias("n_coerced"), F.sum("v").alias("total"),
    )


@query("""SELECT o_orderkey, o_totalprice, 0.0::DOUBLE AS o_discount, o_custkey::DOUBLE AS o_custkey,
       0.0::DOUBLE AS "days.late" FROM orders""")
def signature_align(spark, sf):
    signature = ["o_totalprice", "o_discount", "o_custkey", "days.late"]
    return align_signature(table(spark, sf, "orders"), signature, ("o_orderkey",))[0]


_MONTHLY = """m AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, o_orderstatus AS s,
                   sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)"""


def _monthly_wide(spark, sf):
    orders = table(spark, sf, "orders").select(
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ym"), "o_orderstatus", "o_totalprice"
    )
    statuses = distinct_values(orders, "o_orderstatus")
    return pivot_series(orders, "ym", "o_orderstatus", F.sum("o_totalprice"), statuses, "Close_")


@query(f"""WITH {_MONTHLY},
k AS (SELECT DISTINCT year, month FROM m), s AS (SELECT DISTINCT s FROM m)
SELECT year::BIGINT AS year, month::BIGINT AS month, 'Close_' || s.s AS variable, round(m.v, 2) AS value
FROM k CROSS JOIN s LEFT JOIN m USING (year, month, s)""")
def melt_series(spark, sf):
    wide = _monthly_wide(spark, sf)
    series = [c for c in wide.columns if c != "ym"]
    return melt(wide, ["ym"], series).select(
        F.floor(F.col("ym") / 100).alias("year"), (F.col("ym") % 100).cast("long").alias("month"),
        "variable", F.round("value", 2).alias("value"),
    )


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day,
  max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS "Close_F",
  max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS "Close_O",
  max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS "Close_P"
FROM orders GROUP BY 1""")
def pivot_daily(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus", "o_totalprice"
    )
    return pivot_series(orders, "day", "o_orderstatus", F.max("o_totalprice"), ["F", "O", "P"], "Close_")


@query("""SELECT d.doc_id, coalesce(l.quality, 3) AS quality, coalesce(l.toxic, 0) AS toxic, 'Senior' AS seniority
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def request_defaults(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return with_defaults(d, {"quality": 3, "toxic": 0, "seniority": "Senior"})


@query("""SELECT o_orderkey, o_totalprice AS "Real_r1", o_totalprice * 2 AS "Pred_r1" FROM orders""")
def rename_by_prefix(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("Real rating"),
        (F.col("o_totalprice") * 2).alias("Pred rating"),
    )
    return rename_prefixed(rename_prefixed(o, "Real", "r1"), "Pred", "r1")
