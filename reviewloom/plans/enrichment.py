"""Orders enriched with customer, nation, region and price series."""

from pyspark.sql import functions as F

from . import query, table
from ..functions.fixed_values import MISSING_LOCATION
from ..functions.strings import last_field, replace_sentinel, second_field
from ..operators.bounds import settle
from ..operators.enrich import (
    add_series_changes, left_lookup, monthly_changes, period_changes, recode, replace_unknown_by_mode, unique_keys,
)
from ..sources.tables import union_all

_CHANGES = """
o AS (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS mi FROM orders
      LEFT JOIN customer ON o_custkey = c_custkey),
p AS (SELECT c_mktsegment AS series, mi, avg(o_totalprice) AS mean_close FROM o GROUP BY 1, 2
      UNION ALL SELECT 'index', mi, avg(o_totalprice) FROM o GROUP BY mi),
ch AS (SELECT p.series, p.mi, p.mean_close,
              (p.mean_close - a.mean_close) / a.mean_close AS cm, (p.mean_close - b.mean_close) / b.mean_close AS cy
       FROM p LEFT JOIN p a ON a.series = p.series AND a.mi = p.mi - 1
              LEFT JOIN p b ON b.series = p.series AND b.mi = p.mi - 12)"""


def _orders_with_customer(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day")
    )
    return left_lookup(orders, table(spark, sf, "customer"), {"o_custkey": "c_custkey"},
                       {"c_mktsegment": "c_mktsegment", "c_nationkey": "c_nationkey"})


def _price_changes(orders):
    prices = union_all(
        orders.select(F.col("c_mktsegment").alias("series"), "day", "o_totalprice"),
        orders.select(F.lit("index").alias("series"), "day", "o_totalprice"),
    )
    return monthly_changes(prices, "series", "day", "o_totalprice")


@query(f"""WITH {_CHANGES}
SELECT r_name, c_mktsegment, count(*) AS n_orders, round(avg(o_totalprice), 2) AS mean_price,
       round(avg(s.cm), 6) AS stock_month, round(avg(s.cy), 6) AS stock_year,
       round(avg(i.cm), 6) AS index_month, round(avg(i.cy), 6) AS index_year
FROM o LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN ch s ON s.series = c_mktsegment AND s.mi = o.mi LEFT JOIN ch i ON i.series = 'index' AND i.mi = o.mi
GROUP BY 1, 2""")
def enrich_dimensions(spark, sf):
    orders = _orders_with_customer(spark, sf)
    changes = settle(_price_changes(orders), "price-changes")
    nation = unique_keys(table(spark, sf, "nation"), ["n_nationkey"], "nation")
    out = left_lookup(orders, nation, {"c_nationkey": "n_nationkey"}, {"n_regionkey": "n_regionkey"})
    out = left_lookup(out, table(spark, sf, "region"), {"n_regionkey": "r_regionkey"}, {"r_name": "r_name"})
    out = out.withColumn("series", F.col("c_mktsegment"))
    out = add_series_changes(out, changes, "series", "day", "stock")
    out = add_series_changes(out, changes, "series", "day", "index", only="index")
    mean = lambda c: F.round(F.avg(c), 6)
    return out.groupBy("r_name", "c_mktsegment").agg(
        F.count("*").alias("n_orders"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"),
        mean("stock_percchange_month").alias("stock_month"), mean("stock_percchange_year").alias("stock_year"),
        mean("index_percchange_month").alias("index_month"), mean("index_percchange_year").alias("index_year"),
    )


@query(f"""WITH {_CHANGES}
SELECT series, CAST(mi // 12 AS BIGINT) AS year, CAST(mi % 12 + 1 AS BIGINT) AS month,
       round(cm, 6) AS percchange_month, round(cy, 6) AS percchange_year FROM ch""")
def monthly_change(spark, sf):
    changes = _price_changes(_orders_with_customer(spark, sf))
    return changes.select(
        "series", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"),
        F.round("percchange_month", 6).alias("percchange_month"), F.round("percchange_year", 6).alias("percchange_year"),
    )


@query("""WITH d AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS day, max(o_totalprice) AS close
                    FROM orders GROUP BY 1, 2),
r AS (SELECT series, day, CAST(date_trunc('month', day) - INTERVAL 1 MONTH AS DATE) AS ms, CAST(date_trunc('year', day) AS DATE) AS ys FROM d),
m AS (SELECT r.series, r.day, count(*) AS n, arg_min(d.close, d.day) AS f, arg_max(d.close, d.day) AS l
      FROM r JOIN d ON d.series = r.series AND d.day >= r.ms AND d.day < r.day GROUP BY 1, 2),
y AS (SELECT r.series, r.day, count(*) AS n, arg_min(d.close, d.day) AS f, arg_max(d.close, d.day) AS l
      FROM r JOIN d ON d.series = r.series AND d.day >= r.ys AND d.day < r.day GROUP BY 1, 2)
SELECT r.series, strftime(r.day, '%Y-%m-%d') AS day,
       round(CASE WHEN m.n >= 2 THEN (m.l - m.f) / m.f ELSE 0 END, 6)::DOUBLE AS percchange_month,
       round(CASE WHEN y.n >= 2 THEN (y.l - y.f) / y.f ELSE 0 END, 6)::DOUBLE AS percchange_year
FROM r LEFT JOIN m USING (series, day) LEFT JOIN y USING (series, day)""")
def mtd_ytd_change(spark, sf):
    daily = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")
    ).agg(F.max("o_totalprice").alias("close"))
    asked = daily.select("series", "day")
    return period_changes(daily, asked, "series", "day", "close").select(
        "series", F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.round("percchange_month", 6).alias("percchange_month"), F.round("percchange_year", 6).alias("percchange_year"),
    )


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'Missing value' ELSE 'Town, ' || lower(n_name) END AS loc
                    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT *, CASE WHEN loc = 'Missing value' THEN 'HQ, nation_' || length(c_mktsegment) ELSE loc END AS filled FROM c),
v AS (SELECT n_name, 'N' || n_nationkey AS symbol FROM nation WHERE n_regionkey <> 2),
s AS (SELECT c_custkey, c_mktsegment, coalesce(symbol, upper(trim(split_part(filled, ',', 2)))) AS st
      FROM f LEFT JOIN v ON n_name = upper(trim(split_part(filled, ',', 2)))),
t AS (SELECT c_mktsegment, st, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, st) AS rn FROM s GROUP BY 1, 2)
SELECT s.c_mktsegment, CASE WHEN s.st IN (SELECT symbol FROM v) THEN s.st ELSE t.st END AS state, count(*) AS n_rows
FROM s JOIN t ON t.c_mktsegment = s.c_mktsegment AND t.rn = 1 GROUP BY 1, 2""")
def fill_by_mode(spark, sf):
    nation = table(spark, sf, "nation")
    c = left_lookup(table(spark, sf, "customer"), nation, {"c_nationkey": "n_nationkey"}, {"n_name": "n_name"})
    located = c.select(
        "c_mktsegment",
        F.when(F.col("c_acctbal") < 0, F.lit(MISSING_LOCATION))
        .otherwise(F.concat(F.lit("Town, "), F.lower("n_name"))).alias("location"),
    )
    # Headquarters are one row per company, joined rather than looked up on the driver.
    companies = settle(located.select("c_mktsegment").distinct().select(
        "c_mktsegment", F.concat(F.lit("HQ, nation_"), F.length("c_mktsegment").cast("string")).alias("hq")
    ), "companies")
    filled = left_lookup(located, companies, {"c_mktsegment": "c_mktsegment"}, {"hq": "hq"}).withColumn(
        "location", replace_sentinel(F.col("location"), MISSING_LOCATION, F.col("hq"))
    )
    symbols = nation.where("n_regionkey <> 2").select(
        "n_name", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("symbol")
    )
    states = filled.select("c_mktsegment", second_field(F.col("location")).alias("state"))
    states = recode(states, "state", symbols, "n_name", "symbol")
    states = replace_unknown_by_mode(states, ["c_mktsegment"], "state", symbols, "symbol")
    return states.groupBy("c_mktsegment", "state").agg(F.count("*").alias("n_rows"))


@query("""WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE
                    c_name || ',  ' || lower(n_name) || ' , ' || r_name END AS loc
             FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, CASE WHEN contains(loc, ',') THEN upper(trim(split_part(loc, ',', 2))) ELSE loc END AS second_part,
       trim(nullif(regexp_extract(loc, ',\\s*([^,]+)$', 1), '')) AS region_part FROM l""")
def location_parse(spark, sf):
    c = left_lookup(table(spark, sf, "customer"), table(spark, sf, "nation"), {"c_nationkey": "n_nationkey"},
                    {"n_name": "n_name", "n_regionkey": "n_regionkey"})
    c = left_lookup(c, table(spark, sf, "region"), {"n_regionkey": "r_regionkey"}, {"r_name": "r_name"})
    full = F.concat("c_name", F.lit(",  "), F.lower("n_name"), F.lit(" , "), "r_name")
    loc = F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(full)
    return c.select("c_custkey", second_field(loc).alias("second_part"), last_field(loc).alias("region_part"))
