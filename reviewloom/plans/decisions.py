"""Metrics, calibration and the decision layer."""

from pyspark.sql import functions as F

from . import query, sql_split, table
from ..functions.fixed_values import SUB_RATINGS
from ..operators import evaluate as E
from ..operators.encode import hash_split

_RATED = f"""s AS (SELECT *, 1 + (l_quantity - 1) * 4 / 49 AS y, 1 + l_extendedprice / 25000 + l_discount AS p,
       {sql_split('l_orderkey')} AS split FROM lineitem)"""


def _rated(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag",
        (1 + (F.col("l_quantity") - 1) * 4 / 49).alias("y"),
        (1 + F.col("l_extendedprice") / 25000 + F.col("l_discount")).alias("p"),
    )
    return hash_split(lines, "l_orderkey")


_METRICS = """count(*) AS n_rows, round(avg(abs(y - p) / greatest(abs(y), pow(2, -52))), 6) AS mape, round(avg((y - p) ** 2), 6) AS mse,
  round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS r2"""


@query(f"WITH {_RATED} SELECT split, l_returnflag AS test_set, {_METRICS} FROM s GROUP BY 1, 2")
def regression_metrics(spark, sf):
    m = E.regression_metrics(_rated(spark, sf).withColumnRenamed("l_returnflag", "test_set"), "y", "p", ("split", "test_set"))
    return m.select("split", "test_set", "n_rows", *[F.round(c, 6).alias(c) for c in ("mape", "mse", "mae", "rmse", "r2")])


@query(f"""WITH {_RATED}, m AS (SELECT split, avg(abs(y - p) / abs(y)) AS mape FROM s GROUP BY 1)
SELECT round(max(mape) FILTER (split = 'test') - max(mape) FILTER (split = 'train'), 6) AS mape_gap FROM m""")
def train_test_gap(spark, sf):
    m = E.regression_metrics(_rated(spark, sf), "y", "p", ("split",))
    return E.train_test_gap(m, "split").select(F.round("mape_gap", 6).alias("mape_gap"))


@query(f"""WITH {_RATED}, f AS (SELECT regr_slope(y, p) AS a, regr_intercept(y, p) AS b FROM s WHERE split = 'train'),
c AS (SELECT l_returnflag, a, b, greatest(1.0, least(5.0, a * p + b)) AS q FROM s, f)
SELECT l_returnflag, round(any_value(a), 6) AS slope, round(any_value(b), 6) AS intercept, round(min(q), 6) AS low,
       round(max(q), 6) AS high, round(avg(q), 6) AS mean FROM c GROUP BY 1""")
def linear_calibration(spark, sf):
    rated = _rated(spark, sf)
    line = E.fit_calibration(rated.where("split = 'train'"), "y", "p")
    out = rated.select("l_returnflag", E.calibrate(F.col("p"), line).alias("q"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return out.groupBy("l_returnflag").agg(
        r(F.lit(line[0]), "slope"), r(F.lit(line[1]), "intercept"), r(F.min("q"), "low"), r(F.max("q"), "high"), r(F.avg("q"), "mean")
    )


@query("""WITH k AS (SELECT o_orderkey, 1 + o_totalprice / 125000 AS m, CASE WHEN o_orderkey % 3 = 0 THEN 3.0 ELSE 1.0 + o_custkey % 5 END AS r,
                    CASE WHEN o_orderkey % 2 = 0 THEN 3.0 ELSE 4.0 END AS q FROM orders),
b AS (SELECT o_orderkey, CASE WHEN r = 3 AND q = 3 THEN m ELSE 0.5 * m + 0.5 * ((3 * r + 3 * q) / 6) END AS p FROM k)
SELECT o_orderkey, round(p, 6) AS predicted_rating, CASE WHEN p >= 4 THEN 'Alto' ELSE 'Bajo' END AS satisfaction,
       round(least(abs(p - 4) / 2, 1), 3) AS confidence FROM b""")
def blend_label_confidence(spark, sf):
    first = F.when(F.col("o_orderkey") % 3 == 0, 3.0).otherwise(1.0 + F.col("o_custkey") % 5)
    second = F.when(F.col("o_orderkey") % 2 == 0, 3.0).otherwise(4.0)
    orders = table(spark, sf, "orders").select(
        "o_orderkey", (1 + F.col("o_totalprice") / 125000).alias("model_rating"),
        *[(first if i % 2 else second).alias(c) for i, c in enumerate(SUB_RATINGS)],
    )
    out = E.decide(orders, "model_rating", SUB_RATINGS)
    return out.select("o_orderkey", F.round("predicted_rating", 6).alias("predicted_rating"), "satisfaction", "confidence")


@query("""SELECT o_orderkey, o_totalprice AS real, l.value AS pred FROM orders JOIN
(SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS value FROM lineitem GROUP BY 1) l USING (o_orderkey)""")
def join_predictions(spark, sf):
    real = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("real"))
    pred = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("pred"))
    return E.join_predictions(real, pred, "o_orderkey")
