"""Similarity to per-label centroids and exact neighbours on the embedding table."""

from pyspark.sql import functions as F

from . import query, table
from ..functions.maths import cosine
from ..operators import vectors as V
from ..operators.align import melt

_X = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"


@query(f"""WITH x AS ({_X}),
c AS (SELECT label AS dim, i, avg(x) AS y FROM x GROUP BY 1, 2),
p AS (SELECT vec_id, dim, sum(x * y) AS xy, sqrt(sum(x * x)) * sqrt(sum(y * y)) AS norm FROM x JOIN c USING (i) GROUP BY 1, 2)
SELECT vec_id, 'sim_' || dim AS dimension, round(CASE WHEN norm = 0 THEN 0 ELSE xy / norm END, 6)::DOUBLE AS similarity FROM p""")
def dimension_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    dims = V.group_centroids(e, "embedding", "label")
    wide = V.dimension_similarities(e.select("vec_id", "embedding"), "embedding", dims, "label", "vector", "sim_")
    long = melt(wide, ["vec_id"], [c for c in wide.columns if c != "vec_id"], "dimension", "similarity")
    return long.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH x AS ({_X}), o AS (SELECT i, avg(x) AS y FROM x GROUP BY 1)
SELECT vec_id, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS similarity FROM x JOIN o USING (i) GROUP BY 1""")
def vector_cosine(spark, sf):
    """Expression form of the cosine, against the overall mean vector."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    mean = V.group_centroids(e.withColumn("everything", F.lit(0)), "embedding", "everything").first()["vector"]
    target = F.array(*[F.lit(v) for v in mean])
    return e.select("vec_id", F.round(cosine(F.col("embedding"), target), 6).alias("similarity"))


_PAIRS = """p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, b.label,
  sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour)::INTEGER AS rank FROM p)"""


@query(f"WITH {_PAIRS} SELECT query, neighbour, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5")
def knn_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    found = V.nearest_neighbours(e, e, "vec_id", "embedding", 5, exclude_self=True)
    return found.select("query", "neighbour", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH {_PAIRS}
SELECT query, round(CASE WHEN count(*) FILTER (distance = 0) > 0 THEN avg(label) FILTER (distance = 0)
       ELSE sum(label / nullif(distance, 0)) / sum(1 / nullif(distance, 0)) END, 6) AS prediction
FROM r WHERE rank <= 7 GROUP BY query""")
def knn_regress(spark, sf):
    e = table(spark, sf, "embeddings")
    out = V.knn_regress(e, e, "vec_id", "embedding", "label", 7, weights="distance", exclude_self=True)
    return out.withColumn("prediction", F.round("prediction", 6))


@query("SELECT count(*) AS n_queries, 1 AS recall_reached, 0::BIGINT AS n_wrong FROM embeddings WHERE vec_id % 50 = 0")
def knn_inverted_file(spark, sf):
    """Neighbours from the nearest cells of an index, held against the exact search: at least nine of ten are found, and
    whatever is found has its exact distance."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 50 = 0")
    index = V.inverted_file(e, "vec_id", "embedding", 5)
    found = V.nearest_neighbours(asked, e, "vec_id", "embedding", 5, exclude_self=True, centres=index.centres, probes=index.probes)
    exact = V.nearest_neighbours(asked, e, "vec_id", "embedding", 5, exclude_self=True)
    pairs = exact.select("query", "neighbour", F.col("distance").alias("right")).join(found.select("query", "neighbour", "distance"), ["query", "neighbour"], "left")
    return pairs.agg(
        F.countDistinct("query").alias("n_queries"), (F.count("distance") >= 0.9 * F.count("*")).cast("int").alias("recall_reached"),
        F.count_if(F.col("distance") != F.col("right")).alias("n_wrong"))
