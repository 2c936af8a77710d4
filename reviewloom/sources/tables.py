"""Readers, writers and the incremental patterns around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.fixed_values import GOLD_COLUMNS
from .csv_ranges import read_csv_by_name
from .landing import land, path_exists

# Canonical name -> name in each review dialect (None where the dialect lacks it), in the
# order of the dialect's columns; ratings stay text until the lenient cast.
SOURCE_A_MAP = {
    "company": "firm", "date": "date_review", "job_title": "job_title", "current": "current",
    "location": "location", "overall_rating": "overall_rating", "wl_balance": "work_life_balance",
    "culture_values": "culture_values", "diversity_inclusion": "diversity_inclusion",
    "career_opportunities": "career_opp", "compensation_benefits": "comp_benefits",
    "senior_management": "senior_mgmt", "recommend": "recommend", "ceo_approv": "ceo_approv",
    "outlook": "outlook", "summary": "headline", "pros": "pros", "cons": "cons", "advice": None,
}
SOURCE_B_MAP = {
    "company": "firm_link", "date": "date", "job_title": "job", "current": "status", "location": None,
    "overall_rating": "rating", "wl_balance": "Work/Life Balance", "culture_values": "Culture & Values",
    "diversity_inclusion": "Diversity & Inclusion", "career_opportunities": "Career Opportunities",
    "compensation_benefits": "Compensation and Benefits", "senior_management": "Senior Management",
    "recommend": "Recommend", "ceo_approv": "CEO Approval", "outlook": "Business Outlook",
    "summary": "title", "pros": "pros", "cons": "cons", "advice": "advice",
}


SOURCE_A_SCHEMA, SOURCE_B_SCHEMA = (
    ", ".join(f"`{c}` string" for c in mapping.values() if c) for mapping in (SOURCE_A_MAP, SOURCE_B_MAP))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | list[str], schema: str, corrupt: str | None = None) -> DataFrame:
    """CSV with a header and an explicit schema in the header's order, from any URI Spark can read.

    A header that names other columns, or the same in another order, is an error. Records may span lines, so a file
    is one task here: :func:`read_csv_by_name` reads large files in parallel, and files whose headers differ.
    With ``corrupt`` unreadable records are kept whole in that column.
    """
    reader = (
        spark.read.option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
        # A null marker no file holds keeps an empty field (null) apart from a quoted empty string.
        .option("nullValue", "\u0000").option("emptyValue", "").option("enforceSchema", False)
    )
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
        schema = f"{schema}, `{corrupt}` string"
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export that :func:`read_csv` reads back unchanged, empty strings included."""
    (
        df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
        .option("emptyValue", '""').option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def convert_csv(spark: SparkSession, path: str | list[str], schema: str, target: str, corrupt: str | None = None) -> DataFrame:
    """CSV files to Parquet, columns by name, in parallel also within a file."""
    read_csv_by_name(spark, path, schema, corrupt).drop("file_name").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_folder(spark: SparkSession, folder: str | list[str], schema: str) -> DataFrame:
    """All files of a folder, or of a list of paths, with their file name; columns by the header of each file."""
    return read_csv_by_name(spark, folder, schema)


def company_from_file(file_name: Column) -> Column:
    return F.split(file_name, "_").getItem(0)


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key: a top-k, not an arbitrary prefix."""
    return df.orderBy(key).limit(n)


def append_gold_rows(df: DataFrame, path: str, now: Column | None = None, load: str | None = None) -> DataFrame:
    """Append scored rows in the fixed gold order, stamped with the ingestion time; streams may fill the same table.

    A job that names its ``load`` can be run again without adding its rows twice.
    """
    rows = gold_rows(df, now)
    land(rows, path, load)
    return rows


def gold_rows(df: DataFrame, now: Column | None = None) -> DataFrame:
    stamp = now if now is not None else F.current_timestamp()
    have = set(df.columns)
    return df.select(
        stamp.cast("string").alias("timestamp"),
        *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in GOLD_COLUMNS if c != "timestamp"],
    )


def replace_table(df: DataFrame, path: str, read_from: tuple[str, ...] = ()) -> None:
    """Overwrite a table, refusing a path that is being read."""
    if path.rstrip("/") in {p.rstrip("/") for p in read_from}:
        raise ValueError("refusing to overwrite a path that is being read")
    df.write.mode("overwrite").parquet(path)


# ---- incremental work --------------------------------------------------------

def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned keys that are not done yet."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append only rows whose keys the target lacks: running it twice adds nothing."""
    spark = df.sparkSession
    new = pending(df, spark.read.parquet(path), keys) if path_exists(spark, path) else df  # the first run has no target yet
    new.write.mode("append").parquet(path)


def missing_periods(df: DataFrame, entity: str, period: Column, first: Column, last: Column) -> DataFrame:
    """(entity, period) pairs between an entity-independent first and last period that have no rows.

    Periods are consecutive integers.  Only the pairs seen are shuffled; each
    spans the gap up to the entity's next one, and the outer ends.
    """
    seen = df.select(entity, period.alias("period")).distinct()
    span = df.agg(first.alias("lo"), last.alias("hi")).first()
    kind = seen.schema["period"].dataType
    low, high = F.lit(span["lo"]).cast(kind), F.lit(span["hi"]).cast(kind)
    order = Window.partitionBy(entity).orderBy("period")
    known = seen.where(F.col("period").isNotNull()).select(
        entity, "period", F.lag("period").over(order).alias("before"), F.lead("period").over(order).alias("after"))
    gap = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast(f"array<{kind.simpleString()}>"))
    after = gap(F.greatest(F.col("period") + 1, low).cast(kind), F.least(F.coalesce(F.col("after") - 1, high), high).cast(kind))
    ahead = F.when(F.col("before").isNull(), gap(low, F.least(F.col("period") - 1, high).cast(kind))).otherwise(
        F.array().cast(f"array<{kind.simpleString()}>"))
    never = seen.groupBy(entity).agg(F.max("period").alias("period")).where("period IS NULL")
    return known.select(entity, F.explode(F.concat(ahead, after)).alias("period")).unionByName(
        never.select(entity, F.explode(gap(low, high)).alias("period")))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every rule, rejected rows with the first failed rule as ``reason``).

    A rule that evaluates to null has failed.
    """
    reason = F.coalesce(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ])
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
