"""Incremental work: what is pending, missing, rejected; rankings and fold profiles."""

from pyspark.sql import functions as F

from . import query, table
from ..operators.evaluate import best_per_group as best, fold_error_profile as fold_profile, rank_within
from ..operators.ranks import contiguous_folds
from ..session import shared_dir
from ..sources.tables import append_new, missing_periods as missing, pending, quarantine


def _days(spark, sf):
    return table(spark, sf, "events").select("event_type", "user_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("""SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events
EXCEPT SELECT user_id, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'click'""")
def backfill_pending(spark, sf):
    """Planned = every active (user, day); done = those with a click."""
    days = _days(spark, sf)
    planned = days.select("user_id", "day").distinct()
    return pending(planned, days.where("event_type = 'click'"), ["user_id", "day"])


@query("""WITH e AS (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', ts::DATE) AS BIGINT) AS period FROM events),
x AS (SELECT u.user_id, unnest(generate_series(lo, hi)) AS period FROM (SELECT DISTINCT user_id FROM e) u,
      (SELECT min(period) AS lo, max(period) AS hi FROM e))
SELECT user_id, period FROM x EXCEPT SELECT user_id, period FROM e""")
def missing_periods(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_date(F.to_date("ts")).cast("bigint").alias("d"))
    return missing(e, "user_id", F.col("d"), F.min("d"), F.max("d"))


@query("SELECT o_orderstatus, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def incremental_append(spark, sf):
    """Three overlapping appends leave every order exactly once."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = shared_dir(spark, "incremental")
    append_new(orders.where("o_orderstatus = 'F'"), path, ["o_orderkey"])
    append_new(orders, path, ["o_orderkey"])
    append_new(orders, path, ["o_orderkey"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey, o_custkey) AS rn FROM orders)
SELECT o_orderpriority, max(o_orderkey) FILTER (rn = 1) AS o_orderkey, max(o_custkey) FILTER (rn = 1) AS o_custkey,
       min(o_totalprice) AS best_o_totalprice, sum(o_custkey)::BIGINT AS sum_o_custkey FROM r GROUP BY 1""")
def best_per_group(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice")
    return best(orders.withColumn("custkey", F.col("o_custkey")), ["o_orderpriority"], "o_totalprice",
                ["o_orderkey", "o_custkey"], ["custkey"]).withColumnRenamed("sum_custkey", "sum_o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rank FROM lineitem")
def rank_per_group(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return rank_within(lines, ["l_returnflag"], "l_quantity").drop("l_returnflag")


@query("""WITH f AS (SELECT *, ntile(5) OVER (ORDER BY o_orderkey) - 1 AS fold FROM orders),
r AS (SELECT fold, o_orderstatus, sqrt(avg((o_totalprice - 250000) ** 2)) AS rmse FROM f GROUP BY 1, 2)
SELECT o_orderstatus, count(*) AS n_folds, round(avg(rmse), 4) AS mean_rmse, round(stddev_pop(rmse), 4) AS std_rmse FROM r GROUP BY 1""")
def fold_error_profile(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(250000.0).alias("pred"))
    out = fold_profile(contiguous_folds(orders, "o_orderkey"), "fold", ["o_orderstatus"], "o_totalprice", "pred")
    return out.select("o_orderstatus", "n_folds", F.round("mean_rmse", 4).alias("mean_rmse"), F.round("std_rmse", 4).alias("std_rmse"))


@query("""WITH e AS (SELECT event_id, event_type, TRY_CAST(substr(props, 7, 2) AS DOUBLE) AS k, value FROM events)
SELECT CASE WHEN k IS NULL THEN 'k is a number' WHEN NOT value <= 200 THEN 'value in range' ELSE 'accepted' END AS reason,
       count(*) AS n_rows, round(sum(value), 2) AS total FROM e GROUP BY 1""")
def reject_quarantine(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", F.substring("props", 7, 2).try_cast("double").alias("k"))
    good, bad = quarantine(e, {"k is a number": F.col("k").isNotNull(), "value in range": F.col("value") <= 200})
    both = good.withColumn("reason", F.lit("accepted")).unionByName(bad)
    return both.groupBy("reason").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))
