"""Column statistics, split checks and quality gates.

Statistics over many columns are one aggregation of a long
``(split, variable, value)`` table, never a job per column.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import (
    CATEGORY_MIN_SHARE, IQR_MAX_DIFFERENCE, OUTLIER_MULTIPLIER, SHARE_MAX_DIFFERENCE,
)
from ..functions.maths import relative_spread
from .align import melt, quoted
from .bounds import distinct_values, settle
from .quantiles import wide_quantiles
from .ranks import exact_quantiles


def top_groups(df: DataFrame, by: list[str], n: int, count: str = "n_rows") -> DataFrame:
    """The n largest groups; the group key breaks ties."""
    return df.groupBy(*by).agg(F.count("*").alias(count)).orderBy(F.desc(count), *by).limit(n)


def count_and_mean(df: DataFrame, by: list[str], value: str, digits: int = 2, *more: Column) -> DataFrame:
    """Rows and mean per group, and whatever else is wanted, in one aggregation."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.round(F.avg(value), digits).alias("mean_value"), *more)


def basic_profile(df: DataFrame, name: str, date: str, rating: str) -> DataFrame:
    """One row: rows, columns, first and last date, mean rating, percent of ratings missing."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.avg(quoted(rating).try_cast("double")).alias("mean_rating"),
        (F.avg(quoted(rating).isNull().cast("double")) * 100).alias("missing_percent"),
    ).select(F.lit(name).alias("dataset"), F.lit(len(df.columns)).alias("n_columns"), "*")


def missing_and_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count, null share and zero share per column, in one pass over the table."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")

    def per_column(c: str) -> Column:
        zero = (quoted(c) == 0) if types[c].startswith(numeric) else F.lit(False)
        return F.struct(
            F.lit(c).alias("column_name"),
            F.count_if(quoted(c).isNull()).alias("n_missing"),
            F.count_if(zero).alias("n_zero"),
        )

    return (
        df.agg(F.count("*").alias("n"), F.array(*[per_column(c) for c in columns]).alias("s"))
        .select("n", F.inline("s"))
        .select(
            "column_name", "n_missing",
            F.try_divide("n_missing", "n").alias("missing_share"),
            F.try_divide("n_zero", "n").alias("zero_share"),
        )
    )


def rows_with_any_nonzero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with any non-zero among the columns, and the column means: the recompute check."""
    any_hit = F.lit(False)
    for c in columns:
        any_hit = any_hit | (F.coalesce(quoted(c), F.lit(0.0)) != 0)
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(any_hit).alias("n_nonzero"),
        *[F.avg(quoted(c)).alias(f"mean_{c}") for c in columns],
    )


def value_shares(df: DataFrame, split: str, column: str) -> DataFrame:
    """Relative frequency per split plus all rows ('all'); nulls count in the denominator only."""
    counts = df.groupBy(split, column).agg(F.count("*").alias("n"))
    both = by_split_and_all(counts, split).groupBy(split, column).agg(F.sum("n").alias("n"))
    both = settle(both, "value-counts")
    totals = both.groupBy(split).agg(F.sum("n").alias("total"))
    return both.where(F.col(column).isNotNull()).join(totals, split).select(
        split, column, "n", (F.col("n") / F.col("total")).alias("share")
    )


def shares_wide(df: DataFrame, split: str, column: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """One row per value with its share in all rows and in every split."""
    shares = value_shares(df, split, column)
    return shares.groupBy(column).agg(*[
        F.max(F.when(F.col(split) == s, F.col("share"))).alias(s) for s in ("all", *splits)
    ])


def class_spread(df: DataFrame, split: str, column: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """Largest (max - min) / min of a class share across all rows and the splits."""
    cols = [F.col(s) for s in ("all", *splits)]
    high, low = F.greatest(*cols), F.least(*cols)
    return shares_wide(df, split, column, splits).agg(F.max(F.try_divide(high - low, low)).alias("max_spread"))


def by_split_and_all(df: DataFrame, split: str) -> DataFrame:
    """Every row once under its split and once under 'all'."""
    return df.withColumn(split, F.explode(F.array(F.lit("all"), F.col(split))))


def iqr_report(df: DataFrame, split: str, columns: list[str], whole: bool = False) -> DataFrame:
    """Quartiles and interquartile range per split and column, with ``whole`` also of all rows, as split 'all'."""
    parts = {str(v): F.col(split) == F.lit(v) for v in distinct_values(df, split)}
    if whole:
        parts["all"] = F.lit(True)
    found = wide_quantiles(df, columns, parts, {"q25": 0.25, "q75": 0.75})
    rows = [(part, c, q["q25"], q["q75"], q["q75"] - q["q25"]) for (part, c), q in found.items()]
    return df.sparkSession.createDataFrame(rows, f"`{split}` string, variable string, q25 double, q75 double, iqr double")


def split_consistency(
    df: DataFrame, split: str, numeric: list[str], categorical: list[str],
    iqr_max: float = IQR_MAX_DIFFERENCE, share_max: float = SHARE_MAX_DIFFERENCE,
    min_share: float = CATEGORY_MIN_SHARE,
) -> DataFrame:
    """Do 'all' and the splits look alike?  One row per check, ``passed`` 1 or 0.

    Numeric columns compare interquartile ranges and are skipped when more than
    half of all values are zero; categories below ``min_share`` of all rows are
    skipped.  Raising on a failed row is the caller's choice.
    """
    reports = []
    if numeric:
        zeros = df.agg(*[
            F.avg(F.coalesce((quoted(c) == 0).cast("double"), F.lit(0.0))).alias(f"z{i}")
            for i, c in enumerate(numeric)
        ]).first()
        checked = [c for i, c in enumerate(numeric) if not (zeros[i] is not None and zeros[i] > 0.5)]
        if checked:
            iqr = iqr_report(df, split, checked, whole=True)
            reports.append(iqr.groupBy("variable").agg(
                F.min("iqr").alias("low"), F.max("iqr").alias("high")
            ).select(
                F.lit("iqr").alias("check_name"), "variable", F.lit("").alias("category"),
                relative_spread(F.col("high"), F.col("low")).alias("difference"),
                F.lit(iqr_max).alias("allowed"),
            ))
    if categorical:
        long = df.select(split, F.inline(F.array(*[
            F.struct(F.lit(c).alias("variable"), quoted(c).cast("string").alias("category")) for c in categorical
        ])))
        # One count table, nulls included, from which totals and known values follow.
        counts = settle(
            by_split_and_all(
                long.groupBy(split, "variable", "category").agg(F.count("*").alias("n")), split
            ).groupBy(split, "variable", "category").agg(F.sum("n").alias("n")),
            "category-counts",
        )
        sizes = counts.groupBy(split, "variable").agg(F.sum("n").alias("total"))
        # The skip rule looks at shares among non-null values, the comparison at shares of all rows.
        known = counts.where((F.col(split) == "all") & F.col("category").isNotNull()).groupBy("variable").agg(
            F.sum("n").alias("known"))
        shares = (
            counts.where("category is not null").join(sizes, [split, "variable"]).join(known, "variable")
            .withColumn("share", F.col("n") / F.col("total"))
        )
        n_splits = sizes.select(split).distinct().count()
        per_category = shares.groupBy("variable", "category").agg(
            F.max(F.when(F.col(split) == "all", F.col("n") / F.col("known"))).alias("overall"),
            F.when(F.count("*") < n_splits, F.lit(0.0)).otherwise(F.min("share")).alias("low"),
            F.max("share").alias("high"),
        )
        reports.append(per_category.where(F.col("overall") >= min_share).select(
            F.lit("share").alias("check_name"), "variable", "category",
            relative_spread(F.col("high"), F.col("low")).alias("difference"),
            F.lit(share_max).alias("allowed"),
        ))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    ok = F.coalesce(F.col("difference") <= F.col("allowed"), F.lit(True))
    return out.withColumn("passed", ok.cast("int"))


def outlier_limits(
    train: DataFrame, columns: list[str], multiplier: float = OUTLIER_MULTIPLIER
) -> dict[str, tuple[float, float]]:
    """(lower, upper) per column: q75 of distinct values minus q25 of non-zero values, times the multiplier.

    A column without values has no limits.  Only distinct values are shuffled, once.
    """
    probs, limits = {"q25": 0.25, "q75": 0.75}, {}
    nulled = train.select(*[quoted(c) for c in columns], *[F.nullif(quoted(c).cast("double"), F.lit(0.0)).alias(f"_nonzero{i}") for i, c in enumerate(columns)])
    every = wide_quantiles(nulled, nulled.columns, {"rows": F.lit(True)}, probs)
    nonzero = {c: every["rows", f"_nonzero{i}"] for i, c in enumerate(columns) if ("rows", f"_nonzero{i}") in every}
    distinct = exact_quantiles(melt(train, [], columns).distinct(), ["variable"], "value", {"q75": 0.75})
    distinct = {r["variable"]: r["q75"] for r in distinct.collect()}
    for c in columns:
        if c in nonzero and c in distinct:
            reach = (distinct[c] - nonzero[c]["q25"]) * multiplier
            limits[c] = (every["rows", c]["q25"] - reach, every["rows", c]["q75"] + reach)
    return limits


def outlier_report(df: DataFrame, split: str, columns: list[str], train: str = "train",
                   multiplier: float = OUTLIER_MULTIPLIER) -> DataFrame:
    """Outlier count and share per split against limits taken from the training split only, from one aggregation."""
    limits = outlier_limits(df.where(F.col(split) == train), columns, multiplier)
    none = F.lit(None).cast("double")

    def counted(c: str) -> Column:
        lower, upper = (F.lit(x) for x in limits[c]) if c in limits else (none, none)
        v = F.nanvl(quoted(c).cast("double"), none)
        hit = F.coalesce((v > upper) | (v < lower), F.lit(False))
        return F.struct(F.lit(c).alias("variable"), lower.alias("lower"), upper.alias("upper"),
                        F.count_if(hit).alias("n_outliers"), F.avg(hit.cast("double")).alias("outlier_share"))

    return df.groupBy(split).agg(F.array(*[counted(c) for c in columns]).alias("_c")).select(split, F.inline("_c"))


def correlation_matrix(df: DataFrame, columns: list[str], min_rows: int = 10) -> DataFrame:
    """Pearson correlation of every column pair on complete rows, null unless more than ``min_rows``.

    One pass sums the Gram matrix, whose size depends on the schema only.  A
    column without variance has no correlation (null).
    """
    complete = df.select(*[quoted(c).cast("double").alias(c) for c in columns])
    for c in columns:
        complete = complete.where(quoted(c).isNotNull())
    names = [f"_c{i}" for i in range(len(columns))]
    vectors = VectorAssembler(inputCols=names, outputCol="_x").transform(complete.toDF(*names)).select("_x")
    n = complete.count()
    matrix = Correlation.corr(vectors, "_x").first()[0].toArray() if n > min_rows else None
    rows = []
    for i, j in combinations(range(len(columns)), 2):
        r = None if matrix is None or math.isnan(matrix[i, j]) else float(matrix[i, j])
        rows.append((columns[i], columns[j], n, r))
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, n_rows bigint, correlation double")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum belongs to the last bin."""
    v = df.select(quoted(column).cast("double").alias("v")).where("v is not null")
    low, high = v.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low = high = 0.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    index = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
    return (
        v.groupBy(index.alias("bin")).agg(F.count("*").alias("n_rows"))
        .select("bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"), "n_rows")
    )


def counts_per_year(df: DataFrame, date: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per year; dates that do not parse are dropped."""
    return (
        df.select(*by, F.year(date).alias("year")).where("year is not null")
        .groupBy(*by, "year").agg(F.count("*").alias("n_rows"))
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if duplicate_keys(df, keys).limit(1).count():
        raise ValueError(f"duplicate values of {keys}")
    return df


def model_input_gates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: complete, mean within 0.05 of 0, deviation within 0.05 of 1."""
    structs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count_if(quoted(c).isNull()).alias("n_missing"),
            F.avg(quoted(c)).alias("mean"), F.stddev_pop(quoted(c)).alias("deviation"),
        )
        for c in columns
    ]
    gate = (
        (F.col("n_missing") == 0) & (F.abs("mean") <= 0.05)
        & (F.col("deviation") >= 0.95) & (F.col("deviation") <= 1.05)
    )
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s")).withColumn(
        "passed", F.coalesce(gate, F.lit(False)).cast("int")
    )
