"""Deduplication and key-set operators.

Keep-first is ``min_by(row, order)`` per key rather than ``row_number``:
it combines on the map side, so a key with a third of all rows still leaves
each task as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.strings import content_key, norm_text, review_id
from .align import quoted


def keep_first(df: DataFrame, key: Column | str, order: list[str]) -> DataFrame:
    """The first row per key in the given order; null is a key like any other."""
    key = F.col(key) if isinstance(key, str) else key
    row = F.struct(*[quoted(c) for c in df.columns])
    return (
        df.groupBy(key.alias("_key"))
        .agg(F.min_by(row, F.struct(*order)).alias("_first"))
        .select("_first.*")
    )


def add_keys(df: DataFrame, pros: Column, cons: Column, company: Column, date: Column) -> DataFrame:
    """``review_id`` and ``content_key`` columns; each field is normalised once, in its own projection."""
    fields = {"_pros": pros, "_cons": cons, "_company": company, "_date": date}
    normal = df.select("*", *[norm_text(c).alias(n) for n, c in fields.items()])
    p, c = F.col("_pros"), F.col("_cons")
    return normal.select(
        *[quoted(x) for x in df.columns],
        review_id(p, c, F.col("_company"), F.col("_date")).alias("review_id"), content_key(p, c).alias("content_key"),
    )


def merge_sources(first: DataFrame, second: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Union in which the first source wins.

    Every row of the first source stays.  A second-source row stays when its key
    is empty, or when no first-source row has the key and it is the first of its
    key in the second source.  One aggregation does both the anti-join and the
    keep-first: the winner of a key belongs to the second source only if the
    first source does not have it.
    """
    both = first.withColumn("_rank", F.lit(0)).unionByName(
        second.withColumn("_rank", F.lit(1)), allowMissingColumns=True
    )
    columns = [c for c in both.columns if c != "_rank"]
    is_second = F.col("_rank") == 1
    # First-source rows take part with their key only; their payload never shuffles.
    row = F.when(is_second, F.struct(*[quoted(c) for c in columns]))
    place = F.when(is_second, F.struct(*order))
    winners = (
        both.where(F.col(key) != "")
        .groupBy(key)
        .agg(F.min("_rank").alias("_rank"), F.min_by(row, place).alias("_first"))
        .where("_rank = 1").select("_first.*")
    )
    exempt = both.where((F.col("_rank") == 0) | (F.col(key) == "")).drop("_rank")
    return exempt.unionByName(winners)


def new_keys_only(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Anti-join on a content key; rows with an empty key always pass."""
    known = seen.where(F.col(key) != "").select(key).distinct()
    keyed = F.coalesce(F.col(key) != "", F.lit(False))
    return df.where(~keyed).unionByName(df.where(keyed).join(known, key, "left_anti").select(*[quoted(c) for c in df.columns]))


def key_overlap(df: DataFrame, key: str, in_b: Column) -> DataFrame:
    """Distinct keys per side, shared keys and the duplicate rate, from one scan and one aggregation."""
    per_key = df.groupBy(key).agg(
        F.max(F.when(in_b, 0).otherwise(1)).alias("in_a"), F.max(F.when(in_b, 1).otherwise(0)).alias("in_b")
    )
    return per_key.agg(
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("keys_a"),
        F.coalesce(F.sum("in_b"), F.lit(0)).alias("keys_b"),
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("keys_shared"),
    ).withColumn(
        "duplicate_percent", F.col("keys_shared") * 100.0 / F.greatest(F.col("keys_a"), F.lit(1)),
    )


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Set intersection of two key columns."""
    return a.select(key).intersect(b.select(key))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows per stage and rows lost against the stage before, as one table."""
    table = None
    for i, (name, df) in enumerate(stages.items()):
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(i).alias("stage"), F.lit(name).alias("name"), "n_rows")
        table = row if table is None else table.unionByName(row)
    return table
