"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each text's shingles are hashed once; the top bits of a hash choose one of 256 bins and a bin keeps its smallest
hash.  An empty bin borrows from the bin its own hash sequence hits first (optimal densification).  A fingerprint
packs the low four bits of each bin, and the likeness of two fingerprints is the share of equal bins, corrected for
the one in sixteen that agree by chance.

Shingles are five lower-cased words; a shorter text is one shingle; a text without words has the empty fingerprint,
which is like itself (1.0) and unlike all others (0.0).  Null text is empty, a null id sorts first, repeated rows
keep a row each, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, WIDTH = 256, 4, 5
PROBES = 24
PER_LONG = 64 // BITS
_REST = (1 << 56) - 1  # what a hash holds below the eight bits that choose its bin
_SPACE = "[\\x20\\x09-\\x0D]+"
_TRIMMED = " \t\n\x0b\x0c\r"
_LOW_NIBBLE_BITS = 0x1111111111111111


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add ``name``: the packed fingerprint of ``text`` as 16 longs, null without words."""
    keep = df.columns
    w, h, s, mins, dense = (f"_{name}_{x}" for x in ("words", "hashes", "sorted", "mins", "dense"))
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TRIMMED))
    df = df.withColumn(w, F.when(trimmed != "", F.split(trimmed, _SPACE)))
    df = df.select(*keep, F.transform(w, lambda x: F.xxhash64(x)).alias(h))
    col = F.col(h)
    at = lambda i, k: F.get(col, i + k)
    shingles = F.when(
        F.size(col) >= WIDTH,
        F.transform(F.sequence(F.lit(0), F.size(col) - WIDTH), lambda i: F.xxhash64(*[at(i, k) for k in range(WIDTH)])),
    ).when(col.isNotNull(), F.array(F.xxhash64(col)))
    # one largest value per bin, so that after sorting the first of each bin is its minimum or this mark
    marks = F.array(*[F.lit((b << 56) | _REST) for b in range(-BINS // 2, BINS // 2)])
    df = df.select(*keep, F.sort_array(F.concat(shingles, marks)).alias(s))
    first = lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(F.col(s), i - 1), 56))
    df = df.select(*keep, F.filter(s, first).alias(mins))
    rest = lambda x: x.bitwiseAND(F.lit(_REST))
    df = df.select(*keep, F.transform(mins, lambda x: F.when(rest(x) != _REST, x)).alias(mins))
    probe = lambda j, t: F.get(F.col(mins), F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int"))
    # where all probes hit empty bins, each full bin draws a number and the smallest gives its value
    drawn = lambda j: F.array_min(F.transform(
        mins, lambda x, i: F.when(x.isNotNull(), F.struct(F.xxhash64(j, i, F.lit("draw")).alias("draw"), x.alias("x"))),
    ))["x"]
    df = df.select(*keep, F.transform(mins, lambda x, j: F.coalesce(x, *[probe(j, t) for t in range(PROBES)], drawn(j))).alias(dense))
    nibble = lambda i: F.get(F.col(dense), i).bitwiseAND(F.lit((1 << BITS) - 1))
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda i: F.aggregate(
        F.sequence(F.lit(0), F.lit(PER_LONG - 1)), F.lit(0).cast("long"),
        lambda acc, k: F.shiftleft(acc, BITS).bitwiseOR(nibble(i * PER_LONG + k)),
    ))
    return df.select(*keep, F.when(F.col(dense).isNotNull(), packed).alias(name))


def text_of(packed: Column) -> Column:
    """A fingerprint as 256 hexadecimal digits; empty without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two packed fingerprints, 0 to 1."""
    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(_LOW_NIBBLE_BITS)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)
    chance = 1 / (1 << BITS)
    share = (1 - unequal / BINS - chance) / (1 - chance)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), share))


def with_next(df: DataFrame, key: str, columns: list[str], buckets: int, tie: str) -> DataFrame:
    """Add ``next_<column>`` of the row that follows by ``key`` (a long, never null); the first follows the last.

    Rows are dealt once, to key ranges of about equal counts; each range also gets a copy of the first row after it,
    so neighbours meet without an ordering of the whole table in one task.
    """
    coarse = min(buckets, 256)
    fine = -(-buckets // coarse)
    edges = df.select(F.percentile_approx(key, [i / coarse for i in range(coarse + 1)], 10000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    inner = F.array(*[F.lit(e).cast("long") for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<bigint>")
    k = F.size(F.filter(inner, lambda e: e <= F.col(key)))
    low, high = (F.get(F.array(*[F.lit(e).cast("double") for e in x or [0]]), k) for x in (edges[:-1], edges[1:]))
    share = (F.col(key).cast("double") - low) / F.nullif(high - low, F.lit(0.0))
    part = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(fine - 1.0), F.floor(share * fine).cast("double"))), F.lit(0.0))
    dealt = df.withColumn("_bucket", k.cast("long") * fine + part.cast("long"))
    firsts = dealt.groupBy("_bucket").agg(F.min(key).alias(key))
    order = Window.partitionBy(F.lit(0)).orderBy("_bucket")  # a row per range
    ends = Window.partitionBy(F.lit(0))
    firsts = firsts.select(
        "_bucket", F.coalesce(F.lead(key).over(order), F.min(key).over(ends)).alias(key), F.lit(True).alias("_copy"))
    copies = df.join(firsts, key)
    both = dealt.withColumn("_copy", F.lit(False)).unionByName(copies.select(*df.columns, "_bucket", "_copy"))
    window = Window.partitionBy("_bucket").orderBy("_copy", key, tie)
    nexts = both.select(*df.columns, "_copy", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return nexts.where(~F.col("_copy")).drop("_copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprint every text, and its edited text: the last half replaced by the start of the next document.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  ``id_col`` holds
    integers; ``buckets`` key ranges are dealt out (the session's shuffle partitions by default).
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    docs = with_next(with_fingerprint(docs, F.col("_text"), "_own"), "_key", ["_text", "_own"], buckets, "_text")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    docs = docs.select(
        "_id", "_own", "next__own", n.cast("long").alias("n_chars"),
        F.concat(F.left("_text", n - half), F.left("next__text", half)).alias("_edited"),
    )
    docs = with_fingerprint(docs, F.col("_edited"), "_other")
    return docs.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("_own")).alias("fingerprint"), text_of(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"), likeness(F.col("_own"), F.col("next__own")).alias("near_next"),
    )
