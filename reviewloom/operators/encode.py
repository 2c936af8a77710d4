"""Feature preparation: split, imputation, encoders, scaler.

Fitting returns small plain values or a small table; transforming is a
projection or one lookup join, carried by the row's own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import date_features
from ..functions.fixed_values import REFERENCE_DATE, SPLIT_SEED, TRAIN_PERCENT
from .align import quoted
from .bounds import distinct_values, settle
from .ranks import exact_quantiles


def hash_bucket(key: Column, seed: int = SPLIT_SEED, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 from a digest: the same row lands in the same bucket in any engine and layout."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(buckets))


def hash_split(df: DataFrame, key: str, seed: int = SPLIT_SEED, train_percent: int = TRAIN_PERCENT,
               name: str = "split") -> DataFrame:
    """Unstratified train/test label per row."""
    is_train = hash_bucket(F.col(key), seed) < train_percent
    return df.withColumn(name, F.when(is_train, F.lit("train")).otherwise(F.lit("test")))


def add_date_features(df: DataFrame, date: str, founded: str, t0: str = REFERENCE_DATE) -> DataFrame:
    return df.withColumns(date_features(F.col(date), F.col(founded), t0))


def fit_target_encoder(train: DataFrame, column: str, target: str) -> tuple[DataFrame, dict[str, float]]:
    """Mean and median of the target per category, and their overall fallbacks.

    Null categories and null targets are left out of the groups.  Training rows
    see their own target, as in the pipeline this follows.
    """
    kind = train.schema[column].dataType
    pairs = train.select(quoted(column).cast("string").alias("_key"), quoted(target).cast("double").alias("_y"))
    # Every row counts once for its category and once for the whole table, so both come from the same scans.
    levels = F.array(F.struct(F.lit(0).alias("_all"), F.col("_key")), F.struct(F.lit(1).alias("_all"), F.lit("").alias("_key")))
    rows = pairs.where("_y is not null").select("_y", F.inline(levels)).where("_key is not null")
    keys = ["_all", "_key"]
    means = rows.groupBy(*keys).agg(F.avg("_y").alias("_mean"))
    stats = settle(means.join(exact_quantiles(rows, keys, "_y", {"_median": 0.5}), keys), "target-encoding")
    overall = stats.where("_all = 1").first()
    per_category = stats.where("_all = 0").select(
        F.col("_key").cast(kind).alias(column),
        F.col("_mean").alias(f"{column}_targenc_mean"), F.col("_median").alias(f"{column}_targenc_median"),
    )
    return per_category, {"mean": overall and overall["_mean"], "median": overall and overall["_median"]}


def apply_target_encoder(df: DataFrame, column: str, stats: DataFrame, overall: dict[str, float]) -> DataFrame:
    out = df.join(stats, column, "left")
    return out.withColumns({
        f"{column}_targenc_{f}": F.coalesce(f"{column}_targenc_{f}", F.lit(v)) for f, v in overall.items()
    })


def out_of_fold_means(df: DataFrame, column: str, target: str, fold: str) -> DataFrame:
    """Target mean per category from the other folds only; the other folds' overall mean as fallback.

    Sums per (category, fold) are small, so leaving a fold out is a subtraction.
    """
    cell = df.where(F.col(target).isNotNull()).groupBy(column, fold).agg(
        F.sum(target).alias("s"), F.count("*").alias("n")
    )
    cell = settle(cell, "fold-sums")
    per_category = cell.groupBy(column).agg(F.sum("s").alias("cs"), F.sum("n").alias("cn"))
    per_fold = cell.groupBy(fold).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    total = cell.agg(F.sum("s"), F.sum("n")).first()
    out = (
        df.join(per_category, column, "left").join(per_fold, fold, "left")
        .join(cell, [column, fold], "left")
    )
    n = F.col("cn") - F.coalesce("n", F.lit(0))
    s = F.col("cs") - F.coalesce("s", F.lit(0.0))
    rest = F.try_divide(F.lit(total[0]) - F.coalesce("fs", F.lit(0.0)), F.lit(total[1]) - F.coalesce("fn", F.lit(0)))
    return out.withColumn(f"{column}_targenc_oof", F.when(n > 0, s / F.nullif(n, F.lit(0))).otherwise(rest)).drop(
        "cs", "cn", "fs", "fn", "s", "n"
    )


def fit_one_hot(train: DataFrame, columns: list[str]) -> dict[str, list]:
    """Categories per column from the training rows."""
    return {c: distinct_values(train, c) for c in columns}


def apply_one_hot(df: DataFrame, categories: dict[str, list]) -> DataFrame:
    """``<column>_<value>_ohe`` columns; unseen and null values are all zeros."""
    return df.withColumns({
        f"{c}_{v}_ohe": F.when(quoted(c) == F.lit(v), 1.0).otherwise(0.0)
        for c, values in categories.items() for v in values
    })


def fit_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column from one aggregation; zero deviation becomes 1."""
    row = train.agg(*[
        s for i, c in enumerate(columns)
        for s in (F.avg(quoted(c)).alias(f"m{i}"), F.stddev_pop(quoted(c)).alias(f"s{i}"))
    ]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[
        ((quoted(c) - F.lit(scaler[c][0])) / F.lit(scaler[c][1])).alias(c) if c in scaler else quoted(c)
        for c in df.columns
    ])
