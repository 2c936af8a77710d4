"""Line dedup by distinct-site spread, in DataFrame functions only.

A line is boilerplate where it stands on at least ``min_sites`` sites and in at least ``min_texts`` different whole
texts; the second condition keeps the lines of a text that is much copied as a whole, which is the work of near-copy
detection.  The sites of all rows count.  Rows are first combined per line and site, so a line of a third of all rows is
no hot group.  Per line hash a HyperLogLog sketch of its sites is aggregated; lines whose estimate is near the threshold
get an exact distinct count.  Boilerplate goes from every document but the one of smallest id that holds it.

Lines are compared without surrounding blanks, by 64-bit hashes; blank lines stay.  Odd input: null texts come out
empty, a null site is a site of its own, null ids are never the smallest beside others, rows repeated under one id are
treated alike, texts of any length are read whole, an empty table gives no rows.  All columns of the input stay, whatever
their names; ``n_lines`` and ``n_removed`` are added, in place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

LG_K = 12
SPREAD = 5 * 1.04 / (1 << LG_K // 2)  # five standard errors of a sketch, as a share


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mark(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c")) == ""


def boilerplate(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, min_texts: int) -> DataFrame:
    """(id, line) pairs of lines to remove, by line hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("\0"))).alias("site"), text.alias("text"))
    marks = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), _mark))
    rows = rows.select("id", "site", F.xxhash64("text").alias("whole"), F.explode(marks).alias("line"))
    rows = written(rows, "lines")
    # one row per line and site
    spots = written(rows.groupBy("line", "site").agg(F.min("id").alias("id"), F.min("whole").alias("least"), F.max("whole").alias("most")), "spots")
    several = spots.groupBy("line").agg(
        F.min("site").alias("low"), F.max("site").alias("high"), F.min("id").alias("keeper"), F.min("least").alias("least"), F.max("most").alias("most"))
    several = several.where("least < most" if min_texts > 1 else "true").where("low < high" if min_sites > 1 else "true").select("line", "keeper")
    spots = spots.select("line", "site").join(several, "line")
    sketched = spots.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.first("keeper", ignorenulls=True).alias("keeper"))
    sketched = written(sketched.where(F.col("sites") >= min_sites * (1 - SPREAD) - 1), "sketched")
    sure = sketched.where(F.col("sites") > min_sites * (1 + SPREAD) + 1).select("line", "keeper")
    near = sketched.where(F.col("sites") <= min_sites * (1 + SPREAD) + 1)
    exact = spots.select("line", "site").join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count("*").alias("n"))
    found = sure.unionByName(near.join(exact.where(F.col("n") >= min_sites), "line").select("line", "keeper"))
    texts = rows.select("line", "whole").join(found.select("line"), "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n"))
    found = written(found.join(texts.where(F.col("n") >= min_texts), "line").select("line", "keeper"), "boilerplate")
    pairs = rows.select("id", "line").join(found, "line")
    return pairs.where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "line")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_texts: int = 10) -> DataFrame:
    """The documents with boilerplate lines taken out of their texts."""
    pairs = boilerplate(docs, id_col, text_col, site_col, min_sites, min_texts)
    gone = pairs.groupBy("id").agg(F.collect_set("line").alias("lines"), F.lit(True).alias("some"))
    # the row rides along as one column, so that its columns can be called anything
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("d").join(
        gone.alias("g"), F.col("d.row").getField(id_col).eqNullSafe(F.col("g.id")), "left")
    row, some = F.col("row"), F.col("some")
    text = F.coalesce(row.getField(text_col), F.lit(""))
    kept = F.filter(_lines(text), lambda x: _blank(x) | ~F.array_contains("lines", _mark(x)))
    both = both.select(
        "row", F.when(some, F.array_join(kept, "\n")).otherwise(text).alias("kept"),
        F.when(text == "", 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"),
        F.when(some, F.size(_lines(text)) - F.size(kept)).otherwise(0).cast("long").alias("n_removed"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return both.select(*[(F.col("kept") if c == text_col else row.getField(c)).alias(c) for c in names], "n_lines", "n_removed")
