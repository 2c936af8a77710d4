"""Slug and substring matching against a list, as equi-joins.

"Equals, starts with ``f-`` or ends with ``-f``" and "contains f" look like
theta joins.  For the first, each distinct value is expanded to the few strings
it could match, and those meet the list in a hash join; for the second, each
distinct value is walked through an automaton of the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import written
from .bounds import SETTLED_ROWS, rows_if_small


def dashed_affixes(slug: Column) -> Column:
    """The slug itself and all its prefixes and suffixes that end at a dash."""
    parts = F.split(slug, "-", -1)
    n = F.size(parts)
    cuts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(cuts, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    suffixes = F.transform(cuts, lambda i: F.array_join(F.slice(parts, i + 1, n - i), "-"))
    return F.array_distinct(F.concat(F.array(slug), prefixes, suffixes))


def _match(values: DataFrame, candidates: Column, entries: DataFrame) -> DataFrame:
    exploded = values.select("_value", F.explode(candidates).alias("_entry"))
    return exploded.join(entries, "_entry").distinct()


def slug_matches(df: DataFrame, column: str, entries: DataFrame, entry: str) -> DataFrame:
    """(value, entry) pairs under the exact / dash-prefix / dash-suffix rule, per distinct value."""
    values = df.select(F.col(column).alias("_value")).where("_value is not null").distinct()
    pairs = _match(
        values, dashed_affixes(F.trim(F.lower("_value"))),
        entries.select(F.col(entry).alias("_entry")).distinct(),
    )
    return pairs.select(F.col("_value").alias(column), F.col("_entry").alias(entry))


def substring_matches(df: DataFrame, column: str, entries: DataFrame, entry: str) -> DataFrame:
    """(value, entry) pairs where the lower-cased value contains the entry, per distinct value.

    The looser rule: it also hits ``sse`` in ``credit-suisse``.  Tasks walk each value once through an automaton of all
    entries (Aho-Corasick), so the work is the characters of the values and the hits.  An automaton holds up to
    ``SETTLED_ROWS`` entries; a longer list is dealt by hash to several, each of which walks the values.
    """
    entries = entries.select(F.col(entry).cast("string").alias("_entry")).where("_entry <> ''").distinct()
    values = df.select(F.col(column).alias("_value")).where("_value is not null").distinct().select("_value", F.lower("_value").alias("_low"))
    found, whole = None, rows_if_small(entries, SETTLED_ROWS)
    shards = [whole] if whole is not None else _shards(entries)
    for rows in shards:
        part = values.mapInArrow(_walker([r["_entry"] for r in rows]), StructType([values.schema["_value"], StructField("_entry", StringType())]))
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("_value").alias(column), F.col("_entry").alias(entry))


def _shards(entries: DataFrame) -> Iterator[list[Row]]:
    """The entries in parts of at most ``SETTLED_ROWS``; a part that is larger by chance is dealt again."""
    n = 2 * entries.count() // SETTLED_ROWS + 1
    while n:
        number = F.pmod(F.xxhash64("_entry"), F.lit(n))
        if entries.groupBy(number.alias("s")).count().where(F.col("count") > SETTLED_ROWS).isEmpty():
            break
        n *= 2
    entries = written(entries.withColumn("_shard", number), "entries")
    for k in range(n):
        yield entries.where(F.col("_shard") == k).select("_entry").collect()


def _walker(entries: list[str]):
    """A function over (value, lower-cased value) batches that gives each value with the entries in it."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for e in entries:
            automaton.add_word(e, e)
        if entries:
            automaton.make_automaton()
        for b in batches:
            at, hits = [], []
            for i, low in enumerate(b.column(1).to_pylist() if entries else ()):
                inside = {e for _, e in automaton.iter(low)}
                at += [i] * len(inside)
                hits += inside
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], names=["_value", "_entry"])

    return walk


def keep_matching(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """Rows whose value occurs in a pair table."""
    return df.join(pairs.select(column).distinct(), column, "left_semi")


def entries_in_use(df: DataFrame, column: str, entries: DataFrame, entry: str) -> DataFrame:
    """Each distinct entry with 1 when it occurs in the data as a substring, else 0."""
    hits = substring_matches(df, column, entries, entry).select(entry).distinct()
    return (
        entries.select(entry).distinct()
        .join(hits.withColumn("used", F.lit(1)), entry, "left")
        .select(entry, F.coalesce("used", F.lit(0)).alias("used"))
    )


def entity_presence(
    entities: DataFrame, entity: str, slug: str, a: DataFrame, b: DataFrame, column: str
) -> DataFrame:
    """Rows of two sources that contain any slug of each entity; entities without rows are dropped.

    Rows are first counted per distinct value, so the pair table stays small
    whatever the sources weigh, and a row counts once per entity even when
    several of its slugs match.
    """
    counts = (
        a.select(column, F.lit("rows_a").alias("side")).unionByName(b.select(column, F.lit("rows_b").alias("side")))
        .groupBy(column).agg(
            F.count_if(F.col("side") == "rows_a").alias("rows_a"),
            F.count_if(F.col("side") == "rows_b").alias("rows_b"),
        )
    )
    pairs = substring_matches(counts, column, entities, slug)
    hits = pairs.join(entities.select(entity, slug).distinct(), slug).select(entity, column).distinct()
    return (
        hits.join(counts, column)
        .groupBy(entity)
        .agg(F.sum("rows_a").alias("rows_a"), F.sum("rows_b").alias("rows_b"))
        .withColumn("total", F.col("rows_a") + F.col("rows_b"))
    )


def map_whitelist(df: DataFrame, column: str, whitelist: DataFrame, slug: str) -> tuple[DataFrame, DataFrame]:
    """(known rows with the dictionary's attributes, rows per value the dictionary lacks)."""
    dictionary = whitelist.withColumnRenamed(slug, column)
    known = df.join(dictionary, column)
    unknown = (
        df.groupBy(column).agg(F.count("*").alias("n_rows"))
        .join(dictionary.select(column), column, "left_anti")
    )
    return known, unknown
