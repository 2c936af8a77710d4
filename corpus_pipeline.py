"""A corpus from raw documents: each stage works on what the one before it has kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import decontaminate, jaccard_join, line_dedup, pieces, toxicity
from reviewloom.session import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier flags by the threshold of their language go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, score_col="_toxicity")
    return scored.where(~toxicity.flagged(model, "_toxicity")).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go from the texts; every document stays."""
    out = line_dedup.remove_boilerplate(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id."""
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = leaks.select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_leaked"]), "left_anti")


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they read back as the text; columns of these names are replaced."""
    vocabulary, added = pieces.load(), ("pieces", "n_pieces", "piece_score", "same", "_decoded")
    names = [c for c in docs.columns if c not in added]
    out = pieces.decode(pieces.encode(docs.select(*names), vocabulary), vocabulary, text_col="_decoded")
    same = F.col("_decoded") == F.coalesce(F.col("text"), F.lit(""))
    return out.select(*names, "pieces", F.size("pieces").alias("n_pieces"), "piece_score", same.alias("same"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_test_items),
    ("sentencepiece", as_pieces),
]

#: The classifier and the pieces have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
