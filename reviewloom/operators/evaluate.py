"""Regression metrics, calibration, the decision layer and per-group rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed_values import RATING_MAX, RATING_MIN
from ..functions.maths import blend, clip, confidence, satisfaction_label
from ..session import written
from .align import quoted

EPSILON = 2.0 ** -52


def join_predictions(real: DataFrame, predicted: DataFrame, key: str, how: str = "inner") -> DataFrame:
    return real.join(predicted, key, how)


def metric_columns(y: Column, p: Column) -> list[Column]:
    """MAPE, MSE, MAE, RMSE and R2 as aggregates; R2 is null for a constant target."""
    error = y - p
    mse = F.avg(error * error)
    return [
        F.count("*").alias("n_rows"),
        F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
        mse.alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(mse).alias("rmse"),
        (1 - mse / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
    ]


def regression_metrics(df: DataFrame, y: str, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of metrics per group (split, test set)."""
    return df.groupBy(*by).agg(*metric_columns(F.col(y), F.col(p)))


def train_test_gap(metrics: DataFrame, split: str, metric: str = "mape") -> DataFrame:
    at = lambda s: F.max(F.when(F.col(split) == s, F.col(metric)))
    return metrics.agg((at("test") - at("train")).alias(f"{metric}_gap"))


def fit_calibration(df: DataFrame, y: str, p: str) -> tuple[float, float]:
    """Least-squares (slope, intercept) of the target on the prediction."""
    row = df.agg(F.regr_slope(y, p).alias("a"), F.regr_intercept(y, p).alias("b")).first()
    return (row["a"], row["b"]) if row["a"] is not None else (1.0, 0.0)


def calibrate(p: Column, line: tuple[float, float], low: float = RATING_MIN, high: float = RATING_MAX) -> Column:
    return clip(F.lit(line[0]) * p + F.lit(line[1]), low, high)


def decide(df: DataFrame, model: str, ratings: list[str]) -> DataFrame:
    """Blend with the given ratings, label at the threshold, confidence."""
    rated = df.withColumn("predicted_rating", blend(F.col(model), [F.col(r) for r in ratings]))
    return rated.withColumns({
        "satisfaction": satisfaction_label(F.col("predicted_rating")),
        "confidence": confidence(F.col("predicted_rating")),
    })


def best_per_group(df: DataFrame, by: list[str], metric: str, carry: list[str], sums: list[str]) -> DataFrame:
    """Attributes of the row with the smallest metric per group, with sums over all its rows.

    ``min_by`` combines on the map side; ties go to the smallest attributes.
    """
    row = F.struct(*carry)
    best = F.min_by(row, F.struct(metric, *carry))
    return df.groupBy(*by).agg(
        best.alias("_best"), F.min(metric).alias(f"best_{metric}"), *[F.sum(s).alias(f"sum_{s}") for s in sums]
    ).select(*by, "_best.*", f"best_{metric}", *[f"sum_{s}" for s in sums])


def rank_within(df: DataFrame, by: list[str], score: str, name: str = "rank", rows_per_range: int = 1_000_000) -> DataFrame:
    """Rank by descending score; ties share the smallest rank, a null score has none.

    Rows are dealt to ranges of (group, score) of about ``rows_per_range`` rows, so a large group lies in several
    ranges and equal scores in one.  A rank is the rank in the range plus the group's rows in the ranges before it.
    """
    scored = df.where(quoted(score).isNotNull())
    ranges = max(1, -(-scored.count() // rows_per_range))
    dealt = scored.repartitionByRange(ranges, *[quoted(b) for b in by], quoted(score).desc())
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "score-ranges")
    keys = [quoted(b) for b in by]
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[quoted(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_range").alias("_at"),
                          F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    local = dealt.withColumn("_local", F.rank().over(Window.partitionBy(*keys, "_range").orderBy(quoted(score).desc())))
    same = F.col("_range") == F.col("_at")
    for i, b in enumerate(by):
        same = same & quoted(b).eqNullSafe(F.col(f"_by{i}"))
    columns = [quoted(c) for c in df.columns]
    ranked = local.join(starts, same).select(*columns, (F.col("_start") + F.col("_local")).cast("long").alias(name))
    return ranked.unionByName(df.where(quoted(score).isNull()).select(*columns, F.lit(None).cast("long").alias(name)))


def fold_error_profile(df: DataFrame, fold: str, by: list[str], y: str, p: str) -> DataFrame:
    """Mean and population deviation of the per-fold RMSE, per group."""
    error = F.col(y) - F.col(p)
    per_fold = df.groupBy(fold, *by).agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    return per_fold.groupBy(*by).agg(
        F.count("*").alias("n_folds"), F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse")
    )
