"""Streaming queries over the events as JSON files; each drains and returns what landed."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from . import query, table
from .extraction import form_payload
from .text import TAGS, review_dictionary, review_texts, sql_review_features
from ..operators import models as M
from ..operators.featurise import feature_names, row_features
from ..operators.saved import SignatureAssembler, load_pipeline
from ..session import shared_dir, written
from ..sources.landing import keep_parts, read_landed
from ..streaming import scoring as S

def _event_files(spark, sf, name, repeat=False):
    """The events as JSON lines with a form payload; optionally every event sent twice."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").cast("string").alias("submission_id"), F.col("ts").cast("timestamp").alias("ts"),
                    form_payload(e).alias("payload"))
    if repeat:
        rows = rows.withColumn("ts", F.explode(F.array("ts", F.col("ts") + F.expr("INTERVAL 5 SECONDS"))))
    folder = shared_dir(spark, name)
    rows.write.mode("overwrite").json(folder)
    return folder


def _submissions(spark, sf):
    """Documents as form submissions: the start as summary, the whole text as pros, the rest as cons."""
    fields = [F.struct(F.lit(label).alias("label"), F.lit("TEXTAREA").alias("type"), F.col(name).alias("value")) for name, label in (
        ("summary", "Please summarize"), ("pros", "What do you like most"), ("cons", "What would you improve"))]
    form = F.struct(F.struct(F.struct(F.lit("2024-05-01T00:00:00Z").alias("createdAt"), F.array(*fields).alias("fields")).alias("data")).alias("body"))
    return review_texts(spark, sf).select(
        F.col("doc_id").cast("string").alias("submission_id"), F.timestamp_seconds(F.lit(1.7e9) + F.col("doc_id")).alias("ts"), F.to_json(form).alias("payload"))


def _scorer(spark, sf):
    """Features and a pipeline that is fitted on the labelled documents, saved and loaded; used alike for batch and stream."""
    dictionary, labels = review_dictionary(spark, sf), table(spark, sf, "labels").select("doc_id", (1.0 + 4 * F.col("quality")).alias("rating"))
    names, path = feature_names(TAGS), shared_dir(spark, "stream-model")
    # features are made where the texts are read, and once for all passes of the fit: only they meet the labels
    features = row_features(review_texts(spark, sf), dictionary, TAGS).select("doc_id", *names)
    train = written(features.join(labels, "doc_id").select("rating", *names), "stream-train")
    stages = [SignatureAssembler(names)]
    model = M.fit_assembled(stages[0].transform(train).select("features", "rating"), "rating", "elastic_net", {"l1_ratio": 0.5, "alpha": 0.01})
    PipelineModel([*stages, model]).write().overwrite().save(path)
    loaded = load_pipeline(spark, path)

    def score(parsed):
        return loaded.transform(row_features(parsed, dictionary, TAGS)).withColumnRenamed("prediction", "model_rating").drop("features")

    return score


@query(f"WITH {sql_review_features()}".replace("SELECT y.doc_id,", "SELECT CAST(y.doc_id AS VARCHAR) AS submission_id, 1 AS same_as_batch,"))
def stream_score(spark, sf):
    """Forms that arrive twice, parsed, turned into all text features, scored with the loaded pipeline and labelled; each
    lands once, with the score that the batch path gives it."""
    score, events = _scorer(spark, sf), _submissions(spark, sf)
    folder = shared_dir(spark, "submissions")
    events.withColumn("ts", F.explode(F.array("ts", F.col("ts") + F.expr("INTERVAL 5 SECONDS")))).write.json(folder)
    landed = S.append_once(S.read_events(spark, folder), shared_dir(spark, "scored"), shared_dir(spark, "checkpoint"), then=lambda df: S.score_events(df, score))
    batch = S.score_events(events, score).select("submission_id", F.struct("predicted_rating", "satisfaction", "confidence").alias("batch"))
    both = landed.join(batch, "submission_id")
    same = F.struct("predicted_rating", "satisfaction", "confidence") == F.col("batch")
    names = feature_names(TAGS)
    return both.select("submission_id", same.cast("int").alias("same_as_batch"), *[F.round(c, 8).alias(c) if c.endswith("_sia") else F.col(c) for c in names])


@query("""SELECT CAST(event_id AS VARCHAR) AS submission_id, event_type, count(*) OVER () AS n_kept,
(SELECT count(*) FROM events WHERE event_id % 50 = 0) AS n_rejected FROM events WHERE event_id % 50 <> 0""")
def stream_dedup(spark, sf):
    """Files that come latest first, one per batch, every event twice; events without a time are set aside."""
    events = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("submission_id"), F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_type").alias("payload"), F.col("ts").cast("timestamp").alias("_at"))
    cuts = events.select(F.percentile_approx(F.col("_at").cast("double"), [0.25, 0.5, 0.75]).alias("c")).first()["c"]
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_at").cast("double")))
    folder = shared_dir(spark, "late-events")
    for k in reversed(range(4)):  # a write per part, so that files get their times in this order
        own = events.where(part == k).drop("_at")
        own.coalesce(1).write.mode("append").json(folder)
        own.withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 SECONDS")).coalesce(1).write.mode("append").json(folder)
    kept, rejects = shared_dir(spark, "kept"), shared_dir(spark, "rejects")
    out = S.append_once(S.read_events(spark, folder, files_per_batch=1), kept, shared_dir(spark, "checkpoint"), rejects=rejects)
    again = spark.read.parquet(rejects).select("submission_id").distinct().count()
    return out.select("submission_id", F.col("payload").alias("event_type"), F.lit(out.count()).alias("n_kept"), F.lit(again).alias("n_rejected"))


def _rated(df):
    """A fixed rating from the parsed form, so that SQL can say the same."""
    return df.withColumn("model_rating", 1 + F.length("summary") / 2 + F.col("wl_balance") / 10)


_P = """r AS (SELECT ts, event_id, CASE WHEN user_id % 8 BETWEEN 1 AND 5 THEN (user_id % 8)::DOUBLE ELSE 3.0 END AS wl,
                  1 + length(event_type) / 2 AS base, event_type, props FROM events),
m AS (SELECT *, base + wl / 10 AS m FROM r),
g AS (SELECT *, CASE WHEN wl = 3 THEN m ELSE 0.5 * m + 0.5 * ((wl + 15) / 6) END AS p FROM m),
s AS (SELECT *, CASE WHEN p >= 4 THEN 'Alto' ELSE 'Bajo' END AS satisfaction FROM g)"""


def _gold(spark, sf, name):
    scored = S.score_events(S.read_events(spark, _event_files(spark, sf, name)), _rated)
    path = shared_dir(spark, f"{name}-gold")
    S.append_gold(scored, path, shared_dir(spark, "checkpoint")).awaitTermination()
    return path


@query(f"""WITH {_P} SELECT summary, satisfaction, count(*) AS n_rows, round(sum(p), 4) AS total, 17 AS n_columns
FROM (SELECT *, event_type AS summary FROM s) GROUP BY 1, 2""")
def stream_gold(spark, sf):
    gold = read_landed(spark, _gold(spark, sf, "gold-events"))
    return gold.groupBy("summary", "satisfaction").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("predicted_rating"), 4).alias("total"),
        F.lit(len(gold.columns)).alias("n_columns"))


@query(f"""WITH {_P} SELECT strftime(ts, '%Y-%m-%d') AS day, satisfaction, count(*) AS n_events FROM s GROUP BY 1, 2""")
def stream_daily(spark, sf):
    """Per-day class counts kept by a second stream over the gold files; a batch changes the days that it has events of."""
    path = _gold(spark, sf, "daily-events")
    stream = spark.readStream.schema(read_landed(spark, path).schema).parquet(path)
    counts = S.class_counts(stream.withColumn("ts", F.to_timestamp("timestamp")), "ts", "satisfaction")
    target, checkpoint = shared_dir(spark, "daily"), shared_dir(spark, "checkpoint")
    keep_parts(counts, target, checkpoint, ["day", "satisfaction"])
    daily = keep_parts(counts, target, checkpoint, ["day", "satisfaction"])  # a second run without new files changes nothing
    return daily.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "satisfaction", "n_events")
