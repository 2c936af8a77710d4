"""Dimension, lookup and time-series enrichment.

Dimension joins carry no broadcast hint: the optimiser broadcasts a side whose
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
shuffles with skew splitting, so nothing here depends on a dimension staying small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import month_index
from ..functions.maths import percent_change
from .bounds import settle


def unique_keys(dim: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The dimension itself, after refusing duplicate keys (they would multiply rows)."""
    if dim.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"duplicate keys {keys} in {name}")
    return dim


def left_lookup(df: DataFrame, dim: DataFrame, on: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """Left join on ``{left: right}`` keys bringing ``{dim column: output name}``; null keys match null."""
    d = dim.select(
        *[F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())],
        *[F.col(c).alias(o) for c, o in columns.items()],
    )
    cond = None
    for i, left in enumerate(on):
        term = F.col(left).eqNullSafe(F.col(f"_k{i}"))
        cond = term if cond is None else cond & term
    return df.join(d, cond, "left").drop(*[f"_k{i}" for i in range(len(on))])


def recode(df: DataFrame, column: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Dictionary recode, the value itself when the dictionary lacks it."""
    m = mapping.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    return (
        df.join(m, F.col(column) == F.col("_from"), "left")
        .withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
    )


def modes(df: DataFrame, group: list[str], column: str, name: str) -> DataFrame:
    """Most frequent non-null value per group; the smallest value wins a tie.

    Counting per (group, value) first keeps a hot group at one row per distinct value and task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(*group).agg(best["v"].alias(name))


def replace_unknown_by_mode(
    df: DataFrame, group: list[str], column: str, vocabulary: DataFrame, word: str
) -> DataFrame:
    """Values outside the vocabulary become their group's most frequent value."""
    known = vocabulary.select(F.col(word).alias("_word")).distinct()
    joined = df.join(known, F.col(column) == F.col("_word"), "left")
    top = settle(modes(df, group, column, "_mode"), "modes")
    return (
        joined.join(top, group, "left")
        .withColumn(column, F.when(F.col("_word").isNotNull(), F.col(column)).otherwise(F.col("_mode")))
        .drop("_word", "_mode")
    )


def monthly_changes(prices: DataFrame, series: str, date: str, close: str) -> DataFrame:
    """Change of the mean monthly close against one and twelve calendar months before.

    A range frame on the month index looks up exactly one earlier month, so
    missing months give null instead of a shifted value.
    """
    monthly = (
        prices.groupBy(series, month_index(F.col(date)).alias("month_index"))
        .agg(F.avg(close).alias("mean_close"))
    )
    w = Window.partitionBy(series).orderBy("month_index")

    def change(back: int) -> Column:
        before = F.first("mean_close").over(w.rangeBetween(-back, -back))
        return (F.col("mean_close") - before) / F.nullif(before, F.lit(0.0))

    return monthly.select(
        series, "month_index",
        (F.floor(F.col("month_index") / 12)).cast("int").alias("year"),
        (F.pmod("month_index", F.lit(12)) + 1).cast("int").alias("month"),
        "mean_close",
        change(1).alias("percchange_month"),
        change(12).alias("percchange_year"),
    )


def add_series_changes(
    df: DataFrame, changes: DataFrame, series: str, date: str, prefix: str, only: str | None = None
) -> DataFrame:
    """Left join of the monthly and yearly change on (series, year, month).

    With ``only`` a single series (an index) is joined for every row.
    """
    c = changes.select(
        F.col(series).alias("_s"), F.col("month_index").alias("_m"),
        F.col("percchange_month").alias(f"{prefix}_percchange_month"),
        F.col("percchange_year").alias(f"{prefix}_percchange_year"),
    )
    on = F.col("_m") == month_index(F.col(date))
    if only is None:
        on = on & (F.col("_s") == F.col(series))
    else:
        c = c.where(F.col("_s") == only)
    return df.join(c, on, "left").drop("_s", "_m")


def period_changes(daily: DataFrame, asked: DataFrame, series: str, date: str, close: str) -> DataFrame:
    """First-to-last change since the previous month's start and since 1 January, per asked date.

    The range ends the day before the asked date; fewer than two points give 0.
    First closes are aggregated per month and per year, the last close before a
    date comes from one sorted window per series, so no date range is ever joined.
    ``daily`` holds one close per (series, date).
    """
    point = F.struct(F.col(date).alias("d"), F.col(close).alias("c"))

    def first_in(period: Column, name: str) -> DataFrame:
        return daily.groupBy(series, period.alias("_p")).agg(F.min(point).alias(name))

    by_month = first_in(month_index(F.col(date)), "_first_month")
    by_year = first_in(F.year(date), "_first_year")
    # Asked dates and closes on one time line: the last close strictly before each asked date.
    points = daily.select(series, F.col(date).alias("_d"), point.alias("_pt"), F.lit(1).alias("_kind"))
    no_point = F.lit(None).cast(points.schema["_pt"].dataType)
    wants = asked.select(
        series, F.col(date).alias("_d"), no_point.alias("_pt"), F.lit(0).alias("_kind")
    ).distinct()
    w = Window.partitionBy(series).orderBy("_d", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        points.unionByName(wants)
        .withColumn("_last", F.last("_pt", ignorenulls=True).over(w))
        .where("_kind = 0").drop("_pt", "_kind")
    )
    m = month_index(F.col("_d"))

    def lookup(df: DataFrame, table: DataFrame, period: Column, name: str, out: str) -> DataFrame:
        found = table.select(series, "_p", F.col(name).alias(out))
        return df.withColumn("_p", period).join(found, [series, "_p"], "left").drop("_p")

    placed = lookup(placed, by_month, m - 1, "_first_month", "_prev")
    placed = lookup(placed, by_month, m, "_first_month", "_this")
    placed = lookup(placed, by_year, F.year("_d"), "_first_year", "_year")
    start_month = F.coalesce("_prev", "_this")

    def change(start: Column) -> Column:
        two_points = start["d"] < F.col("_last.d")
        return F.when(two_points, percent_change(start["c"], F.col("_last.c"), F.lit(2))).otherwise(F.lit(0.0))

    return placed.select(
        series, F.col("_d").alias(date),
        change(start_month).alias("percchange_month"),
        change(F.col("_year")).alias("percchange_year"),
    )
