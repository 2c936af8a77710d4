"""Feature preparation on orders and customers, fitted on the training split only."""

from pyspark.sql import functions as F

from . import query, sql_split, table
from ..operators import encode as E
from ..operators.align import fill_family
from ..operators.enrich import left_lookup
from ..operators.ranks import contiguous_folds
from ..session import written

_SPLIT = f"s AS (SELECT *, {sql_split('o_orderkey')} AS split FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"


def _orders(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day")
    )
    orders = left_lookup(orders, table(spark, sf, "customer"), {"o_custkey": "c_custkey"}, {"c_nationkey": "nation"})
    return E.hash_split(orders, "o_orderkey")


@query(f"""WITH {_SPLIT},
k AS (SELECT o_orderkey, split, o_totalprice, CASE WHEN o_orderkey % 50 = 0 THEN NULL
             WHEN split = 'test' AND c_nationkey = 3 THEN -1 ELSE c_nationkey END AS nation FROM s),
g AS (SELECT nation, avg(o_totalprice) AS m, median(o_totalprice) AS md FROM k WHERE split = 'train' AND nation IS NOT NULL GROUP BY 1),
a AS (SELECT avg(o_totalprice) AS m, median(o_totalprice) AS md FROM k WHERE split = 'train')
SELECT o_orderkey, round(coalesce(g.m, a.m), 5) AS nation_targenc_mean, round(coalesce(g.md, a.md), 5) AS nation_targenc_median
FROM k CROSS JOIN a LEFT JOIN g USING (nation)""")
def target_encode(spark, sf):
    """Null categories and a category seen only in test take the overall value."""
    nation = F.when(F.col("o_orderkey") % 50 == 0, None).when(
        (F.col("split") == "test") & (F.col("nation") == 3), -1).otherwise(F.col("nation"))
    orders = written(
        _orders(spark, sf).select("o_orderkey", "split", "o_totalprice", nation.alias("nation")), "split-orders")
    stats, overall = E.fit_target_encoder(orders.where("split = 'train'"), "nation", "o_totalprice")
    out = E.apply_target_encoder(orders, "nation", stats, overall)
    return out.select("o_orderkey", *[F.round(c, 5).alias(c) for c in ("nation_targenc_mean", "nation_targenc_median")])


@query("""WITH n AS (SELECT count(*) AS n FROM orders),
f AS (SELECT o.*, c_nationkey AS nation, CASE WHEN rn <= (n % 5) * (n // 5 + 1) THEN (rn - 1) // (n // 5 + 1)
             ELSE n % 5 + (rn - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold
      FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) o CROSS JOIN n LEFT JOIN customer ON o_custkey = c_custkey),
t AS (SELECT f.o_orderkey, sum(c.s) AS s, sum(c.n) AS n FROM f JOIN
      (SELECT nation, fold, sum(o_totalprice) AS s, count(*) AS n FROM f GROUP BY 1, 2) c ON c.nation = f.nation AND c.fold <> f.fold GROUP BY 1)
SELECT o_orderkey, round(t.s / t.n, 5) AS nation_targenc_oof FROM t""")
def target_encode_out_of_fold(spark, sf):
    orders = contiguous_folds(_orders(spark, sf), "o_orderkey")
    out = E.out_of_fold_means(orders, "nation", "o_totalprice", "fold")
    return out.select("o_orderkey", F.round("nation_targenc_oof", 5).alias("nation_targenc_oof"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_OHE = ", ".join(
    f"CASE WHEN pr = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"priority_{v}_ohe\"" for v in _PRIORITIES)


@query(f"""WITH {_SPLIT}, k AS (SELECT o_orderkey, CASE WHEN split = 'test' AND o_orderkey % 7 = 0 THEN 'NEW' ELSE o_orderpriority END AS pr FROM s)
SELECT o_orderkey, {_OHE} FROM k""")
def one_hot(spark, sf):
    """A category that training never saw becomes all zeros."""
    unseen = (F.col("split") == "test") & (F.col("o_orderkey") % 7 == 0)
    orders = _orders(spark, sf).select(
        "o_orderkey", "split", F.when(unseen, "NEW").otherwise(F.col("o_orderpriority")).alias("priority")
    )
    fitted = E.fit_one_hot(orders.where("split = 'train'"), ["priority"])
    return E.apply_one_hot(orders, fitted).drop("split", "priority")


@query("""SELECT doc_id, coalesce(quality, 0)::DOUBLE AS "q_ld_.", coalesce(toxic, 0)::DOUBLE AS "q_ld_``", toxic AS plain
FROM documents LEFT JOIN labels USING (doc_id)""")
def impute_family(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    wide = d.select("doc_id", F.col("quality").cast("double").alias("q_ld_."), F.col("toxic").cast("double").alias("q_ld_``"),
                    F.col("toxic").alias("plain"))
    return fill_family(wide, "_ld_", 0.0)


@query("""WITH k AS (SELECT o_orderkey, o_orderdate::DATE AS d, make_date(CAST(1985 + o_custkey % 20 AS INTEGER), 1, 1) AS f FROM orders)
SELECT o_orderkey, month(d)::INTEGER AS month, year(d)::INTEGER AS year, date_diff('day', d, DATE '2024-01-01')::INTEGER AS "days from review to t0",
       date_diff('day', f, DATE '2024-01-01')::INTEGER AS "days from foundation to t0",
       greatest(0, date_diff('day', f, d))::INTEGER AS "days from foundation to review" FROM k""")
def date_features(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), (F.lit(1985) + F.col("o_custkey") % 20).cast("int").alias("founded")
    )
    return E.add_date_features(orders, "day", "founded").drop("day", "founded")


@query(f"""WITH {_SPLIT}, f AS (SELECT avg(o_totalprice) AS mp, stddev_pop(o_totalprice) AS sp, avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn
                  FROM s WHERE split = 'train')
SELECT o_orderkey, split, round((o_totalprice - mp) / sp, 6) AS o_totalprice, round((c_nationkey - mn) / sn, 6) AS nation FROM s, f""")
def standard_scale(spark, sf):
    orders = _orders(spark, sf).select("o_orderkey", "split", "o_totalprice", "nation")
    scaled = E.apply_scaler(orders, E.fit_scaler(orders.where("split = 'train'"), ["o_totalprice", "nation"]))
    return scaled.select("o_orderkey", "split", F.round("o_totalprice", 6).alias("o_totalprice"), F.round("nation", 6).alias("nation"))
