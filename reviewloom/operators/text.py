"""Text features from dictionary tables, and keyword tables.

Tokens are exploded, looked up in the dictionary and summed per document.  The
tokens of a document lie in one task, so the sums combine there and only one row
per document is shuffled.  A dictionary that passes the size check is broadcast;
a larger one is an ordinary skew-safe join.  One scan of the texts in either case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed_values import LABEL_ALL
from ..functions.strings import is_keyword, letter_words, raw_keywords, word_count, words
from .align import quoted
from .bounds import distinct_values, settle


def add_lengths(df: DataFrame, fields: list[str]) -> DataFrame:
    """``<field>_charlen`` and ``<field>_wordlen``; null counts as empty."""
    out = {}
    for f in fields:
        out[f"{f}_charlen"] = F.length(F.coalesce(quoted(f), F.lit("")))
        out[f"{f}_wordlen"] = word_count(quoted(f))
    return df.withColumns(out)


def category_counts(
    df: DataFrame, key: str, text: str, dictionary: DataFrame, token: str, category: str,
    categories: list[str], tokens=letter_words,
) -> DataFrame:
    """``key``, token count ``n_tokens`` and one hit count column ``n_<category>`` per category.

    A token in several categories counts once in each.  ``key`` is unique.
    """
    flags = [F.max((F.col(category) == c).cast("int")).alias(f"_f{i}") for i, c in enumerate(categories)]
    entries = settle(
        dictionary.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("_t")).agg(*flags), "dictionary"
    )
    per_token = df.select(key, F.explode_outer(tokens(quoted(text))).alias("_t")).join(entries, "_t", "left")
    return per_token.groupBy(key).agg(
        F.count("_t").alias("n_tokens"),
        *[F.coalesce(F.sum(f"_f{i}"), F.lit(0)).alias(f"n_{c}") for i, c in enumerate(categories)],
    )


def shares_of_hits(counts: DataFrame, key: str, categories: list[str], prefix: str) -> DataFrame:
    """Category hits / all category hits; zeros when nothing hits."""
    total = F.lit(0)
    for c in categories:
        total = total + quoted(f"n_{c}")
    return counts.select(key, *[
        F.when(total == 0, F.lit(0.0)).otherwise(quoted(f"n_{c}") / F.nullif(total, F.lit(0))).alias(f"{prefix}{c}")
        for c in categories
    ])


def shares_of_tokens(counts: DataFrame, key: str, categories: list[str], prefix: str,
                     absent_is_null: bool = False) -> DataFrame:
    """Category hits / tokens (1 when there are none).  Tags that do not occur may be left null."""
    total = F.greatest(F.col("n_tokens"), F.lit(1))
    def share(c: str) -> Column:
        value = quoted(f"n_{c}") / total
        return F.when(quoted(f"n_{c}") > 0, value) if absent_is_null else value

    return counts.select(key, *[share(c).alias(f"{prefix}{c}") for c in categories])


def vocabulary_ratio(df: DataFrame, key: str, text: str, vocabulary: DataFrame, word: str, name: str) -> DataFrame:
    """White-space tokens of the lower-cased text that are vocabulary words, over all tokens.

    Entries of several words can never equal one token, so they never count.
    """
    one = vocabulary.select(F.col(word).alias("t"), F.lit("v").alias("c"))
    counts = category_counts(df, key, text, one, "t", "c", ["v"], tokens=lambda c: words(F.lower(c)))
    return counts.select(key, (F.col("n_v") / F.greatest(F.col("n_tokens"), F.lit(1))).alias(name))


def valence_compound(
    df: DataFrame, key: str, text: str, valences: DataFrame, token: str, valence: str, name: str
) -> DataFrame:
    """Sum of token valences s, squashed to s / sqrt(s*s + 15).

    Negation, booster and punctuation rules of the published method are not applied.
    """
    entries = settle(
        valences.groupBy(F.col(token).alias("_t")).agg(F.sum(F.col(valence).cast("double")).alias("_v")), "valences"
    )
    per_token = df.select(key, F.explode_outer(letter_words(quoted(text))).alias("_t")).join(entries, "_t", "left")
    scored = per_token.groupBy(key).agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_s"))
    return scored.select(key, (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15.0)).alias(name))


def word_frequencies(df: DataFrame, text: str, stopwords: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Keyword counts, overall or per group."""
    return (
        df.select(*by, F.explode(raw_keywords(quoted(text))).alias("word"))
        .where(is_keyword(F.col("word"), stopwords))
        .groupBy(*by, "word").agg(F.count("*").alias("frequency"))
    )


def top_words(df: DataFrame, text: str, n: int, stopwords: list[str]) -> DataFrame:
    return word_frequencies(df, text, stopwords).orderBy(F.desc("frequency"), "word").limit(n)


def top_words_by_class(counts: DataFrame, source: str, label: str, classes: list[str], n: int) -> DataFrame:
    """The n most frequent words per (source, class) and per source over all rows.

    ``counts`` has ``word`` and ``frequency`` beside source and class, at any grain (per document, say), so texts
    are exploded once and never joined.  'All' also holds rows whose class is null or unknown.
    """
    slots = F.when(F.col(label).isin(*classes), F.array(F.col(label), F.lit(LABEL_ALL))).otherwise(
        F.array(F.lit(LABEL_ALL))
    )
    both = (
        counts.select(source, F.explode(slots).alias(label), "word", "frequency")
        .groupBy(source, label, "word").agg(F.sum("frequency").alias("frequency"))
    )
    rank = F.row_number().over(Window.partitionBy(source, label).orderBy(F.desc("frequency"), "word"))
    return both.withColumn("position", rank).where(F.col("position") <= n)


def tag_frequency_columns(df: DataFrame, key: str, tag: str, prefix: str, known: list[str] | None = None) -> DataFrame:
    """Long (key, tag) rows to one relative-frequency column per tag.

    Conditional counts combine on the map side; no list of tags is ever built.
    """
    known = known or distinct_values(df, tag)
    return df.groupBy(key).agg(*[
        (F.count_if(F.col(tag) == t) / F.count("*")).alias(f"{prefix}{t}") for t in known
    ])
