"""Column profiles, split checks and quality gates."""

from pyspark.sql import functions as F

from . import query, sql_split, table
from ..functions.dates import lenient_date
from ..operators import profile as P
from ..operators.encode import apply_scaler, fit_scaler, hash_split
from ..session import written

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", *NUMERIC)
    return hash_split(lines, "l_orderkey")


def _lines_once(spark, sf):
    """The labelled rows written once: a split is a table, not something to derive in every scan."""
    return written(_lines(spark, sf), "split-lines")


def _sql_long(where="true"):
    parts = [f"SELECT split, '{c}' AS variable, {c} AS value FROM s" for c in NUMERIC]
    return f"""s AS (SELECT *, {sql_split('l_orderkey')} AS split FROM lineitem),
one AS ({' UNION ALL '.join(parts)}),
long AS (SELECT * FROM one WHERE {where} UNION ALL SELECT 'all', variable, value FROM one)"""


@query("""SELECT 'orders' AS dataset, 6 AS n_columns, count(*) AS n_rows, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date,
  strftime(max(o_orderdate), '%Y-%m-%d') AS last_date, round(avg(o_totalprice), 4) AS mean_rating,
  avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100 AS missing_percent FROM orders
UNION ALL SELECT 'events', 6, count(*), strftime(min(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%d'), round(avg(value), 4),
  avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100 FROM events""")
def dataset_profile(spark, sf):
    orders = P.basic_profile(table(spark, sf, "orders"), "orders", "o_orderdate", "o_totalprice")
    events = P.basic_profile(table(spark, sf, "events"), "events", "ts", "value")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return orders.unionByName(events).select(
        "dataset", "n_columns", "n_rows", day("first_date"), day("last_date"),
        F.round("mean_rating", 4).alias("mean_rating"), "missing_percent",
    )


@query("SELECT c_mktsegment AS grp, count(*) AS n_rows, round(avg(c_acctbal), 2) AS mean_value, count(DISTINCT c_nationkey) AS n_nations FROM customer GROUP BY 1")
def group_count_mean(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "grp")
    return P.count_and_mean(c, ["grp"], "c_acctbal", 2, F.countDistinct("c_nationkey").alias("n_nations"))


@query("SELECT p_name, count(*) AS n_rows FROM part GROUP BY p_name ORDER BY n_rows DESC, p_name LIMIT 20")
def top_groups(spark, sf):
    return P.top_groups(table(spark, sf, "part"), ["p_name"], 20)


@query("""WITH j AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT unnest(['doc_id', 'lang', 'n_chars', 'quality', 'toxic']) AS column_name,
       unnest([count(*) - count(doc_id), count(*) - count(lang), count(*) - count(n_chars), count(*) - count(quality), count(*) - count(toxic)]) AS n_missing,
       unnest([count(*) - count(doc_id), count(*) - count(lang), count(*) - count(n_chars), count(*) - count(quality), count(*) - count(toxic)]) / count(*) AS missing_share,
       unnest([count(*) FILTER (doc_id = 0), 0, count(*) FILTER (n_chars = 0), count(*) FILTER (quality = 0), count(*) FILTER (toxic = 0)]) / count(*) AS zero_share
FROM j""")
def missing_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return P.missing_and_zero(d.join(table(spark, sf, "labels"), "doc_id", "left"))


_SHARES = f"""j AS (SELECT d.doc_id, l.quality, {sql_split('d.doc_id')} AS split FROM documents d LEFT JOIN labels l USING (doc_id)),
u AS (SELECT split, quality FROM j UNION ALL SELECT 'all', quality FROM j),
t AS (SELECT split, count(*) AS total FROM u GROUP BY 1),
v AS (SELECT split, quality, count(*) AS n, count(*) / any_value(total) AS share FROM u JOIN t USING (split)
      WHERE quality IS NOT NULL GROUP BY 1, 2)"""


def _labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return hash_split(d.join(table(spark, sf, "labels"), "doc_id", "left"), "doc_id")


@query(f"WITH {_SHARES} SELECT split, quality, n, share FROM v")
def value_shares(spark, sf):
    return P.value_shares(_labelled(spark, sf), "split", "quality")


@query(f"""WITH {_SHARES} SELECT quality, max(CASE WHEN split = 'all' THEN share END) AS "all",
max(CASE WHEN split = 'train' THEN share END) AS train, max(CASE WHEN split = 'test' THEN share END) AS test FROM v GROUP BY 1""")
def value_shares_wide(spark, sf):
    return P.shares_wide(_labelled(spark, sf), "split", "quality")


@query(f"""WITH {_SHARES}, w AS (SELECT quality, max(share) AS hi, min(share) AS lo FROM v GROUP BY 1)
SELECT round(max((hi - lo) / lo), 9) AS max_spread FROM w""")
def class_spread(spark, sf):
    return P.class_spread(_labelled(spark, sf), "split", "quality").select(F.round("max_spread", 9).alias("max_spread"))


@query(f"""WITH {_sql_long()}
SELECT split, variable, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75,
       round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM long GROUP BY 1, 2""")
def iqr_report(spark, sf):
    report = P.iqr_report(_lines_once(spark, sf), "split", NUMERIC, whole=True)
    return report.select("split", "variable", *[F.round(c, 6).alias(c) for c in ("q25", "q75", "iqr")])


@query(f"""WITH {_sql_long()},
dq AS (SELECT variable, quantile_cont(value, 0.75) AS d75 FROM (SELECT DISTINCT variable, value FROM one WHERE split = 'train') GROUP BY 1),
q AS (SELECT variable, quantile_cont(value, 0.25) FILTER (value <> 0) AS z25, quantile_cont(value, 0.25) AS q25,
             quantile_cont(value, 0.75) AS q75 FROM one WHERE split = 'train' GROUP BY 1),
lim AS (SELECT variable, q25 - (d75 - z25) * 0.1 AS lower, q75 + (d75 - z25) * 0.1 AS upper FROM q JOIN dq USING (variable))
SELECT split, variable, round(any_value(lower), 6) AS lower, round(any_value(upper), 6) AS upper,
       count(*) FILTER (value > upper OR value < lower) AS n_outliers,
       round(count(*) FILTER (value > upper OR value < lower) / count(*), 9) AS outlier_share
FROM one JOIN lim USING (variable) GROUP BY 1, 2""")
def outlier_report(spark, sf):
    """Multiplier 0.1 instead of the default 10, so that this data has outliers to count."""
    report = P.outlier_report(_lines_once(spark, sf), "split", NUMERIC, multiplier=0.1)
    return report.select(
        "split", "variable", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"),
        "n_outliers", F.round("outlier_share", 9).alias("outlier_share"),
    )


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS n_rows, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
    for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]))
def corr_matrix(spark, sf):
    out = P.correlation_matrix(table(spark, sf, "lineitem"), NUMERIC)
    return out.withColumn("correlation", F.round("correlation", 6))


WIDE = {f"{c}_{k}": f"{c} % {k}" for c in NUMERIC[:2] for k in range(3, 14)} | {"same": "7.0::DOUBLE"}


@query(f"""WITH w AS (SELECT {', '.join(f'{e} AS {n}' for n, e in WIDE.items())} FROM lineitem)
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS n_rows, CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN round(corr({a}, {b}), 6) END AS correlation FROM w"
    for i, a in enumerate(WIDE) for b in list(WIDE)[i + 1:]))
def corr_wide(spark, sf):
    """Twenty-three columns, one of them constant."""
    wide = table(spark, sf, "lineitem").select(*[F.expr(e.replace("::DOUBLE", "D")).alias(n) for n, e in WIDE.items()])
    return P.correlation_matrix(wide, list(WIDE)).withColumn("correlation", F.round("correlation", 6))


@query("""WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 10)) AS INTEGER), 9) AS bin, lo, hi FROM lineitem, m)
SELECT bin, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 10), 4) AS bin_start, count(*) AS n_rows FROM b GROUP BY bin""")
def histogram10(spark, sf):
    return P.histogram(table(spark, sf, "lineitem"), "l_extendedprice").withColumn("bin_start", F.round("bin_start", 4))


@query("""WITH d AS (SELECT o_orderstatus, CASE WHEN o_custkey % 11 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)
SELECT o_orderstatus, CAST(year(TRY_CAST(s AS DATE)) AS INTEGER) AS year, count(*) AS n_rows FROM d WHERE TRY_CAST(s AS DATE) IS NOT NULL GROUP BY 1, 2""")
def yearly_counts(spark, sf):
    day = F.when(F.col("o_custkey") % 11 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return P.counts_per_year(table(spark, sf, "orders"), lenient_date(day), ("o_orderstatus",))


_CATS = " UNION ALL ".join(
    f"SELECT split, '{c}' AS variable, {c} AS category FROM s" for c in ("l_returnflag", "l_linestatus"))


@query(f"""WITH {_sql_long()},
q AS (SELECT split, variable, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM long GROUP BY 1, 2),
z AS (SELECT variable FROM one GROUP BY 1 HAVING avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) <= 0.5),
c1 AS ({_CATS}), c AS (SELECT * FROM c1 UNION ALL SELECT 'all', variable, category FROM c1),
n AS (SELECT split, variable, count(*) AS total FROM c GROUP BY 1, 2),
sh AS (SELECT split, variable, category, count(*) / any_value(total) AS share FROM c JOIN n USING (split, variable) GROUP BY 1, 2, 3),
g AS (SELECT variable, category, max(share) FILTER (split = 'all') AS overall, min(share) AS lo, max(share) AS hi FROM sh GROUP BY 1, 2),
r AS (SELECT 'iqr' AS check_name, variable, '' AS category, abs((max(iqr) - min(iqr)) / max(iqr)) AS difference, 0.5 AS allowed
      FROM q JOIN z USING (variable) GROUP BY variable
      UNION ALL SELECT 'share', variable, category, abs((hi - lo) / hi), 0.25 FROM g WHERE overall >= 0.1)
SELECT check_name, variable, category, round(difference, 6) AS difference, allowed::DOUBLE AS allowed,
       CASE WHEN difference <= allowed THEN 1 ELSE 0 END AS passed FROM r""")
def split_consistency(spark, sf):
    report = P.split_consistency(_lines_once(spark, sf), "split", NUMERIC, ["l_returnflag", "l_linestatus"])
    return report.withColumn("difference", F.round("difference", 6))


@query(f"""WITH s AS (SELECT *, {sql_split('l_orderkey')} AS split FROM lineitem),
f AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM s WHERE split = 'train'),
x AS (SELECT (l_quantity - mq) / sq AS q, (l_tax - mt) / st AS t, l_discount AS d FROM s, f WHERE split = 'train'),
r AS (SELECT 'l_quantity' AS column_name, avg(q) AS m, stddev_pop(q) AS s, count(*) - count(q) AS n FROM x
      UNION ALL SELECT 'l_tax', avg(t), stddev_pop(t), count(*) - count(t) FROM x
      UNION ALL SELECT 'l_discount', avg(d), stddev_pop(d), count(*) - count(d) FROM x)
SELECT column_name, n AS n_missing, abs(round(m, 6)) AS mean, round(s, 6) AS deviation,
       CASE WHEN n = 0 AND abs(m) <= 0.05 AND s BETWEEN 0.95 AND 1.05 THEN 1 ELSE 0 END AS passed FROM r""")
def quality_gates(spark, sf):
    train = _lines(spark, sf).where("split = 'train'").select("l_quantity", "l_tax", "l_discount")
    scaled = apply_scaler(train, fit_scaler(train, ["l_quantity", "l_tax"]))
    gates = P.model_input_gates(scaled, ["l_quantity", "l_tax", "l_discount"])
    return gates.select("column_name", "n_missing", F.abs(F.round("mean", 6)).alias("mean"),
                        F.round("deviation", 6).alias("deviation"), "passed")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return P.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
